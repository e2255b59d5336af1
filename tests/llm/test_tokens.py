import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwright.llm import bitplanes, packing
from siftwright.llm.tokens import PieceEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
ENCODER = PieceEncoder(PATH, limit=200)
ODD = ["", " ", "a", " a", "a ", "a  b", "\n\n a\tb \n c", "x\n", "\nx", "foo <|endoftext|> bar", "a<|endoftext|>", "don't we'll 's", "naïve éa, x", "a b", "1 22  333,", "ß. ß, ß"]


@pytest.mark.parametrize("text", ODD)
def test_ids_are_those_of_the_whole_text(text):
    assert ENCODER.encode([text, "between", text])[2].tolist() == ENCODER.whole(text).tolist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abZé,.' \n\t1ß", max_size=40), min_size=1, max_size=6))
def test_any_texts(texts):
    assert [x.tolist() for x in ENCODER.encode(texts)] == [ENCODER.whole(t).tolist() for t in texts]


@pytest.mark.parametrize("mode", ["bit", "byte"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 4096])
def test_planes_round_trip(mode, n):
    ids = np.random.default_rng(n).integers(0, 65536, n).astype(np.uint32)
    assert (bitplanes.unpack(bitplanes.pack(ids, mode=mode)) == ids).all()


def test_wide_ids_and_refusals():
    ids = np.array([70_000, 1], np.uint32)
    assert (bitplanes.unpack(bitplanes.pack(ids, id_bytes=3)) == ids).all()
    with pytest.raises(ValueError):
        bitplanes.pack(ids, id_bytes=2)
    with pytest.raises(ValueError):
        bitplanes.unpack(b"nothing")


@given(st.binary(max_size=60), st.integers(0, 60))
def test_crc_of_parts(data, at):
    a, b = data[:at], data[at:]
    assert bitplanes.crc_of_parts([(len(a), zlib.crc32(a)), (len(b), zlib.crc32(b))]) == zlib.crc32(data)


ROWS = [(3, "three two one", "x"), (1, None, "x"), (2, "", None), (5, "word " * 9000, "x"), (3, "three two one", "x"), (None, "no id", "x")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, start string")


def test_files_hold_all_ids_in_order(spark):
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in bitplanes.round_trip(frame(spark), PATH, 2).collect())
    want, at = [], 0
    for doc_id, text, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.append(ENCODER.whole(text or ""), 2).astype("<u4")
        want.append((at, doc_id, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want


def test_no_documents(spark):
    assert bitplanes.round_trip(frame(spark, []), PATH, 2).count() == 0
    assert packing.pack(frame(spark, []), PATH).count() == 0


def test_pieces_cover_every_document_once(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(i * 7 % 400)), "") for i in range(300)] + ROWS
    got = packing.pack(frame(spark, rows), PATH).toPandas()
    ids = {}
    for doc_id, text, _ in rows:
        ids.setdefault(doc_id, []).append(np.append(ENCODER.whole(text or ""), 0).astype("<u4"))
    assert got["length"].sum() == sum(len(x) for xs in ids.values() for x in xs)
    for r in got[got["doc_id"] != 3].dropna().itertuples():
        x = [x for x in ids[r.doc_id] if len(x) == r.doc_tokens][0]
        assert zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    used = got.groupby("sequence_id")["length"].sum()
    assert used.max() <= 1024 and sorted(used.index) == list(range(len(used)))
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]]
    assert sum(packing.cost(n, 1024) for n in used) < 1.05 * used.sum()


def test_sequences_are_what_the_pieces_say(spark):
    docs = frame(spark, [(i, "word " * i, "") for i in range(1, 40)])
    pieces = packing.pack(docs, PATH, size=64)
    packed = {r["sequence_id"]: len(r["ids"]) for r in packing.sequences(docs, pieces, PATH, size=64).collect()}
    assert packed == {r["sequence_id"]: r["n"] for r in pieces.groupBy("sequence_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}


def test_patterns_place_each_remainder_once():
    rng = np.random.default_rng(2)
    need = np.bincount(rng.integers(1, 1024, 3000), minlength=1024)
    plan, cuts = packing.patterns_for(need, 1024)
    placed = np.zeros(1024, np.int64)
    for p, times in plan:
        assert sum(n * a for n, a in p.items()) <= 1024
        for n, a in p.items():
            placed[n] += a * times
    want = need - cuts
    want[512] += cuts.sum()
    want[1:512] += cuts[513:1024]
    assert (placed[1:] == want[1:]).all()


def test_texts_may_be_arrow_slices():
    whole = pa.array(["skip me", "a b", "c\nd"])
    assert [x.tolist() for x in ENCODER.encode(whole.slice(1))] == [ENCODER.whole(t).tolist() for t in ("a b", "c\nd")]

"""The registered queries on the smallest tables, and the pipeline stage by stage, against plain Python."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from siftwright.llm import langid, pii

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def crc(i):
    return zlib.crc32(str(i).encode())


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def ids(docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {i: t.encode(r["text"] or "", add_special_tokens=False).ids for i, r in docs.items()}


def rows(spark, name):
    return entry.queries()[name](spark, SF).collect()


def test_ids(spark, ids):
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows(spark, "op1_bit_plane_ids")}
    at = 0
    for i in sorted(ids):
        x = np.array([*ids[i], 2], "<u4")
        assert got[i] == (at, len(x), zlib.crc32(x.tobytes()))
        at += len(x)
    assert len(got) == len(ids)


def test_neighbours(spark):
    v = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r["embedding"] is not None}
    names = np.array(sorted(v))
    x = np.stack([v[i] for i in names])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = collections.defaultdict(list)
    for r in sorted(rows(spark, "op2_adaptive_scan_ann"), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == {i for i in names.tolist() if i % 50 == 0}
    hits = 0
    for q, found in got.items():
        s = x @ x[np.searchsorted(names, q)]
        s[names == q] = -9
        hits += len({i for i, _ in found} & set(names[np.lexsort((names, -s))[:5]].tolist()))
        assert all(abs(c - s[np.searchsorted(names, i)]) < 1e-9 for i, c in found) and len(found) == 5
    assert hits >= 0.9 * 5 * len(got)


def test_language(spark, docs):
    got = rows(spark, "op4_language_id")
    assert {r["doc_id"] for r in got} == set(docs) and all(r["held_out"] == (crc(r["doc_id"]) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    judged = [r for r in got if r["held_out"] and docs[r["doc_id"]]["lang"] is not None]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in judged) >= 0.95 * len(judged)


def test_scores(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op3_log_bilinear_scores")}
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = {i: [*WORD.findall((r["text"] or "").translate(low)), None] for i, r in docs.items()}
    c = collections.Counter(w for i, ws in tokens.items() if crc(i) % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc(i) % 5 == 1, len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel=1e-9)
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())


def test_repeated_passages(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op5_repeated_passages")}
    seen = set()
    for i in sorted(docs):
        w, gone = WORD.findall(docs[i]["text"] or ""), set()
        for j in range(len(w) - 19):
            k = tuple(w[j : j + 20])
            if k in seen:
                gone.update(range(j, j + 20))
            seen.add(k)
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_personal_data(spark, docs):
    for r in rows(spark, "op6_pii_spans"):
        base, found = pii.spans(docs[r["doc_id"]]["text"] or "")
        assert r["spans"] == pii.joined(found) and r["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest() and r["n_email"] == sum(k == "email" for k, _, _ in found)


def pieces_hold(got, ids, end):
    covered = collections.defaultdict(list)
    for r in got:
        covered[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for i, x in ids.items():
        x, at = np.array([*x, end], "<u4"), 0
        for start, length, sum_, n in sorted(covered[i]):
            assert start == at and n == len(x) and zlib.crc32(x[start : start + length].tobytes()) == sum_
            at += length
        assert at == len(x)
    places = collections.defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 1024


def test_packing(spark, ids):
    pieces_hold(rows(spark, "op8_pack_cutting_stock"), ids, 0)


def grams(t):
    w = WORD.findall(t or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def classes(texts):
    """Least id of all that a text is similar to, through others, too; and numbers of links."""
    sets, links, parent = {i: grams(t) for i, t in texts.items()}, collections.Counter(), {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    names = sorted(texts)
    for n, i in enumerate(names):
        for j in names[:n]:
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}, links


def test_near_duplicates(spark, docs):
    of, links = classes({i: r["text"] for i, r in docs.items()})
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows(spark, "op9_ngram_jaccard_join")} == {i: (of[i], links[i]) for i in docs}


EXTRA = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, repeats long, target double, block string, piece int, _extra string"


@pytest.fixture(scope="module")
def given(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    own = base.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    full = own.select("*", F.lit(0.5).alias("score"), F.lit("xx").alias("lang_pred"), F.lit(7).cast("long").alias("repeats"), F.lit(1.0).alias("target"), F.lit("b").alias("block"), F.lit(1).alias("piece"), F.lit("e").alias("_extra"))
    longest = base.orderBy(F.desc(F.length("text"))).first()["text"]
    odd = [(None, longest, "en", None, 1), (10_001, None, "en", "web", None), (10_002, "", None, None, 0), (10_003, "123 !?", "en", "web", 6), (10_004, longest, "en", "web", 5), (10_004, longest, "en", "web", 5), (10_005, longest + " write to bob (at) example (dot) com", "en", "web", 5), (10_006, (longest + " ") * 400, "en", None, 5)]
    return full.unionByName(spark.createDataFrame([(*o, 0.1, "q", 1, 2.0, "c", 3, "f") for o in odd], EXTRA)).select(*full.columns)


def test_pipeline_stage_by_stage(spark, given, tmp_path_factory):
    base = tmp_path_factory.mktemp("stages")
    stages, docs = dict(corpus_pipeline.STAGES), given
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert name == "pack" or out.columns == given.columns
        out.write.parquet(str(base / name))
        kept[name] = docs = spark.read.parquet(str(base / name))
    assert len(stages) == 5
    tables = {"given": given.collect(), **{n: d.collect() for n, d in kept.items()}}
    texts = lambda n: collections.Counter((r["doc_id"], r["text"]) for r in tables[n])
    # language: what has no letter goes, the rest of the corpus stays
    left = texts("given") - texts("language")
    assert set(left) == {(10_001, None), (10_002, ""), (10_003, "123 !?")} and not texts("language") - texts("given")
    # near duplicates: the least id of each class stays, with all its rows; rows without id stay
    named = {r["doc_id"]: r["text"] for r in tables["language"] if r["doc_id"] is not None}
    of, _ = classes(named)
    assert {i for i, _ in texts("near_duplicates")} == {i for i in named if of[i] == i} | {None}
    # personal data: each span by its kind
    want = collections.Counter((r["doc_id"], pii.redact(r["text"], pii.spans(r["text"])[1])) for r in tables["near_duplicates"])
    assert texts("personal_data") == want and all(r["n_chars"] == len(r["text"]) for r in tables["personal_data"])
    # mixing: whole repetitions and beginnings, near the targets
    before, after = collections.Counter(), collections.Counter()
    starts = {(r["doc_id"], r["source"]): r["text"] for r in tables["personal_data"]}
    for r in tables["personal_data"]:
        before[r["source"]] += len(WORD.findall(r["text"]))
    for r in tables["mix_sources"]:
        after[r["source"]] += len(WORD.findall(r["text"]))
        assert starts[r["doc_id"], r["source"]].startswith(r["text"])
    assert all(after[s] <= 2 * n + 1 for s, n in before.items()) and abs(sum(after.values()) - min(1.5, 2) * sum(before.values())) < 0.1 * sum(before.values())
    # packing: every row of the mix lies in the sequences once
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = collections.Counter()
    for r in tables["mix_sources"]:
        total[r["doc_id"]] += len(t.encode(r["text"], add_special_tokens=False).ids) + 1
    packed = collections.Counter()
    for r in tables["pack"]:
        packed[r["doc_id"]] += r["length"]
    assert packed == total


def test_run_is_its_stages(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = entry.queries()["pipeline"](spark, SF).collect()
    assert {r["doc_id"] for r in out} <= set(docs) and max(r["offset"] + r["length"] for r in out) <= 1024


def test_the_pipeline_of_nothing(spark, given):
    docs = given.filter("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_short_texts_keep_their_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    assert model.languages == sorted({r["lang"] for r in docs.select("lang").distinct().collect()} - {None})

"""The operators against plain Python, with nulls, empty and repeated rows, ties, empty tables and columns of clashing names."""

import collections
import hashlib
import math
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwright.llm import ann, graph, langid, lm, mixing, neardup, pii, quality, substrings, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, label string, score string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts, langs=None, sources=None, ids=None):
    """Documents, with columns whose names operators use inside."""
    rows = [(ids[i] if ids else i, t, (langs or {}).get(i), (sources or {}).get(i), None if t is None else len(t), "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def texts_with_copies(seed=0, n=60):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(30, 120))) for _ in range(n)]
    passage = " ".join(rng.choice(vocabulary, 40))
    for i in range(0, n, 4):
        w = texts[i].split()
        texts[i] = " ".join([*w[:10], passage, *w[10:]])
    for i in range(1, n, 5):
        w = texts[i - 1].split()
        w[len(w) // 2] = "changed"
        texts[i] = " ".join(w)
    return [*texts, None, "", "   \n", texts[3], texts[3], "one two", "one two", "x" * 5000, "again and " * 400]


# ---- quality ledger


def test_ledger_counts(spark):
    texts = [None, "", "a b", "#1 $2 | x\nline\nline\n\n \nother", "p q r s t u v w " * 5, "é" * 30, "tie tie"]
    got = {r["doc_id"]: r for r in quality.ledger(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        windows = collections.Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        covered = {k for j in range(len(w) - 7) if windows[tuple(w[j : j + 8])] > 1 for k in range(j, j + 8)}
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))


def test_policies_and_ablations(spark):
    entries = quality.ledger(frame(spark, texts_with_copies())).cache()
    p = quality.POLICIES[2]
    kept = quality.apply_policy(entries, p).filter("kept").count()
    bits = [r["fail_bits"] & p.mask for r in entries.collect()]
    assert kept == sum(b == 0 for b in bits)
    for r in quality.ablations(entries, p).collect():
        bit = 1 << quality.BITS[r["rule"]]
        assert (r["failed"], r["failed_alone"], r["kept_alone"]) == (sum(b & bit > 0 for b in bits), sum(b == bit for b in bits), sum(b & bit == 0 for b in bits))
    assert quality.ledger(frame(spark, [])).count() == 0


# ---- mixing


def test_targets_are_the_fixed_point_of_clamping(spark):
    texts = ["w " * n for n in (100, 100, 3, 4, 50, 0, 7)] + [None]
    sources = {0: "a", 1: "a", 2: "b", 3: "b", 4: "c", 5: "d", 6: None, 7: "a"}
    got = mixing.mix(frame(spark, texts, sources=sources)).collect()
    sizes = collections.Counter()
    for i, t in enumerate(texts):
        sizes[sources[i]] += len(WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total >= 2 * sizes[s]}
        if not full:
            target.update({s: left * weight[s] / total for s in open_})
            break
        for s in full:
            target[s] = 2 * sizes[s]
        left -= sum(target[s] for s in full)
        open_ -= full
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
    taken = collections.Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= sum(1 for x in got if x["source"] == s) for s in target)


def test_the_mix_has_as_many_words_as_taken(spark):
    docs = frame(spark, texts_with_copies(), sources={i: "abc"[i % 3] for i in range(40)})
    want = {r["doc_id"]: r["t"] for r in mixing.mix(docs).groupBy("doc_id").agg(F.sum("taken").alias("t")).collect() if r["t"]}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    got = collections.Counter()
    for r in out.collect():
        got[r["doc_id"]] += len(WORD.findall(r["text"] or ""))
    assert {k: v for k, v in got.items() if v} == want
    assert mixing.mix(frame(spark, [])).count() == 0 and mixing.mixed(frame(spark, [])).count() == 0


# ---- language


def test_language(spark):
    rng = np.random.default_rng(1)
    kinds = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["zwei", "uhrwerk", "straße"], "cc": ["niño", "ahora", "quién"]}
    texts, langs = [], {}
    for i in range(90):
        lang = list(kinds)[i % 3]
        texts.append(" ".join(rng.choice(kinds[lang], 30)))
        langs[i] = lang if i % 4 else None
    texts += [None, "", "123 !?", "  "]
    docs = frame(spark, texts, langs)
    model = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert all(got[i]["lang_pred"] == list(kinds)[i % 3] and 0 < got[i]["score"] <= 1 for i in range(90))
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in range(90, 94))
    none = langid.fit(docs.filter("lang IS NULL"))
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(frame(spark, []), model).count() == 0


def test_language_against_exact_sets(spark):
    """The same rule with sets in place of the filter, ties and repeated rows among the documents, and few documents of a language."""
    rng = np.random.default_rng(5)
    kinds = {"aa": "lorem ipsum dolor sit amet".split(), "bb": "zwei uhr werk straße ipso".split(), "cc": "niño ahora quién dolores".split()}
    texts, langs = [], {}
    for i in range(60):
        lang = list(kinds)[i % 3]
        texts.append(" ".join(rng.choice(kinds[lang], 12)))
        langs[i] = lang
    texts += ["lorem zwei ahora", "IPSUM ipso dolor dolores", texts[0], texts[0], "x", "QU", "Straße, lorem! 12 Uhr"] + [" ".join(rng.choice(kinds["aa"], 3)) + " " + " ".join(rng.choice(kinds["cc"], 3)) for _ in range(20)]

    def grams(t):
        s = "".join(c if c.isalpha() else " " for c in f" {t.lower()} ")
        return [s[i : i + n] for n in (2, 3, 4) for i in range(len(s) - n + 1) if " " not in s[i + 1 : i + n - 1] and not (n == 2 and s[i : i + 2] == "  ")]

    def grams_of_parts(t):
        return [g for g in grams(t) if not g.isspace()]

    shares = {}
    for lang in kinds:
        c = collections.Counter(g for i, k in langs.items() if k == lang for g in grams_of_parts(texts[i]))
        shares[lang] = {g: n / sum(c.values()) for g, n in c.items()}
    sets = {k: {g for g, p in own.items() if 3 * p >= max(o.get(g, 0) for o in shares.values())} for k, own in shares.items()}
    docs = frame(spark, texts, langs)
    got = {r["doc_id"]: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    for i, t in enumerate(texts):
        g = grams_of_parts(t)
        known = {k: sum(x in s for x in g) / len(g) for k, s in sets.items()}
        top = sorted(known.values())
        assert got[i]["score"] == pytest.approx(top[-1], abs=0.02) and got[i]["lead"] == pytest.approx(top[-1] - top[-2], abs=0.03)
        if top[-1] - top[-2] > 0.03:
            assert got[i]["lang_pred"] == max(known, key=known.get)
    few = langid.fit(docs, per_language=5, most_languages=2)
    assert few.languages == ["aa", "bb"]


def test_ties_go_to_the_language_that_sorts_first(spark):
    docs = frame(spark, ["same words here"] * 6, {i: "ba"[i % 2] * 2 for i in range(6)})
    got = langid.predict(docs, langid.fit(docs)).collect()
    assert {(r["lang_pred"], r["lead"]) for r in got} == {("aa", 0.0)} and len(got) == 6


def test_false_positives_are_taken_off():
    rng = np.random.default_rng(0)
    masks = rng.integers(0, 256, (2, 1 << 10)).astype(np.uint8)
    model = langid.Model([f"l{i:02}" for i in range(10)], masks, 10)
    known, n = model.known(["".join(rng.choice(list("abcdefghij"), 4000))])
    assert (known / n < 0.1).all()


# ---- personal data

E = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
I = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # noqa: E741
C = re.compile(r"[0-9]([\x20-]?[0-9])+")
P = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(t):
    out = [("email", *m.span()) for m in E.finditer(t)]
    out += [("ip", *m.span()) for m in I.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in C.finditer(t):
        d = re.sub("[ -]", "", m[0])
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in P.finditer(t) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.-+0123 ()%", max_size=60))
def test_base_rules(t):
    assert pii.plain(t) == brute(t)
    assert set(brute(t)) <= set(pii.spans(t)[1])


DISGUISED = [
    ("mail john (at) example (dot) com now", "john (at) example (dot) com"),
    ("to jane.doe [at] mail [dot] example [dot] org.", "jane.doe [at] mail [dot] example [dot] org"),
    ("bob at example dot com", "bob at example dot com"),
    ("call plus one two one two five five five one two three four", "plus one two one two five five five one two three four"),
    ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ ok", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    ("jоhn@exаmple.com x", "jоhn@exаmple.com"),
    ("host one nine two dot one six eight dot one dot one", "one nine two dot one six eight dot one dot one"),
    ("ip 192[.]168[.]1[.]10 e", "192[.]168[.]1[.]10"),
    ("anna at firma dot co dot uk, or", "anna at firma dot co dot uk"),
    ("x at mail dot firma dot ru", "x at mail dot firma dot ru"),
    ("anna dot b at firma dot pl.", "anna dot b at firma dot pl"),
    ("a.b @ c . d . org now", "a.b @ c . d . org"),
    ("card 4111 1111 one one one one 1111", None),
]


@pytest.mark.parametrize(("text", "want"), DISGUISED)
def test_disguises(text, want):
    found = [text[s:e] for _, s, e in pii.spans(text)[1]]
    assert found == ([want] if want else []) or want is None


@pytest.mark.parametrize("text", ["he was at the dot in time. look at me dot", "and looked at it. It was at home", "un deux trois la vie", "one two three four five six seven eight"])
def test_clean_prose_is_left_alone(text):
    assert pii.spans(text) == ([], [])


def test_detect_rows(spark):
    docs = frame(spark, [None, "", "a@b.co +1 555 123 4567", "a@b.co +1 555 123 4567"])
    got = {r["doc_id"]: r for r in pii.detect(docs).collect()}
    assert got[0]["spans"] == got[1]["spans"] == "" and got[2]["spans"] == got[3]["spans"] == "email:0:6,phone:7:22"
    assert got[2]["base_sha256"] == hashlib.sha256(b"email:0:6,phone:7:22").hexdigest()
    assert [r["text"] for r in pii.redacted(docs).orderBy("doc_id").collect()] == [None, "", "[EMAIL] [PHONE]", "[EMAIL] [PHONE]"]
    assert pii.detect(frame(spark, [])).count() == 0


SHAPES = ["1", "a.@", "+1(", "1.1.", "one ", "é", "я", "( ", " ", "(at) ", "a dot ", "a at a dot ", "at dot dot ", "a@b dot ", "@ a . ", "a dot com at ", "x (at) y (dot) com ", "1 dot ", "jоe@x.com ", "a-", "1 1a ", "plus ", "+1 555 123 4567 "]


@pytest.mark.parametrize("shape", SHAPES)
def test_long_texts_take_linear_time(shape):
    began = time.process_time()
    pii.spans(shape * (1_000_000 // len(shape)))
    pii.spans("a" + shape * (1_000_000 // len(shape)) + "(x")
    assert time.process_time() - began < 30


# ---- near duplicates


def shingles(t, n=5):
    w = WORD.findall(t or "")
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def test_join_is_that_of_all_pairs(spark):
    texts = texts_with_copies()
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    links, parent = collections.Counter(), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r for r in neardup.join(frame(spark, texts)).collect()}
    assert {i: (r["class_id"], r["n_links"]) for i, r in got.items()} == {i: (find(i), links[i]) for i in sets}


def test_join_of_nothing_and_of_null_ids(spark):
    assert neardup.join(frame(spark, [])).count() == 0
    docs = frame(spark, ["a b c d e f", "a b c d e f"], ids=[None, 4])
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in neardup.join(docs).collect()} == {None: (None, 0), 4: (4, 0)}


def test_documents_that_only_share_bands_do_not_chain(spark):
    rng = np.random.default_rng(2)
    grams = [f"g{i}" for i in range(400)]
    texts = [" ".join([*grams[k * 40 : k * 40 + 120], *rng.choice(grams, 40)]) for k in range(8)]
    reps = neardup.features(frame(spark, texts), 5, 186, 1).selectExpr("doc_id AS rep", "bands", "sketch")
    assert neardup.candidates(reps, 0.8, 186).count() == 0 and reps.selectExpr("explode(bands) AS k").groupBy("k").count().filter("count > 1").count() > 0


@pytest.mark.parametrize("size", [4, 1024])
def test_large_groups_are_cut_into_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "SKETCH_BLOCK", size)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(0, 200, 10)]
    got = neardup.join(frame(spark, texts)).collect()
    assert {(r["class_id"], r["n_links"]) for r in got} == {(0, len(texts) - 1)}


def test_bands():
    b, r = neardup.bands_and_rows(0.8, 0.9999)
    assert 1 - (1 - 0.8**r) ** b >= 0.9999 and b * r <= 256


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90)], "a long, b long")
    got = {r["node"]: r["label"] for r in graph.components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 90: 90, 100: 90}
    assert graph.components(edges.filter("a < 0")).count() == 0
    odd = spark.createDataFrame([(1, 2), (2, 1), (1, 2), (None, 3), (4, None), (5, 5)], "a long, b long")
    assert {r["node"]: r["label"] for r in graph.components(odd).collect()} == {1: 1, 2: 1}


# ---- repeated passages


@pytest.mark.parametrize("shard", [2048, 0])
def test_removed_words(spark, monkeypatch, shard):
    monkeypatch.setattr(substrings, "SHARD", shard)
    texts = texts_with_copies()
    got = {r["doc_id"]: r for r in substrings.removed(frame(spark, texts)).collect()}
    seen = set()
    for i, t in enumerate(texts):
        w, gone = WORD.findall(t or ""), set()
        for j in range(len(w) - 19):
            k = tuple(w[j : j + 20])
            if k in seen:
                gone.update(range(j, j + 20))
            seen.add(k)
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert substrings.removed(frame(spark, [])).count() == 0


def test_words_that_collide_under_simple_hashes_and_rows_of_one_id(spark):
    thue = [bin(i).count("1") & 1 for i in range(1024)]
    a, b = "".join("ab"[x] for x in thue), "".join("ba"[x] for x in thue)
    assert len(set(words.hashes(pa.array([f"{a} {b}"]))[0].tolist())) == 2
    rng = np.random.default_rng(3)
    passages = [" ".join(f"p{i}q{rng.integers(1000)}" for _ in range(30)) for i in range(8)]
    common = " ".join(f"z{i}" for i in range(20))
    texts, ids = [], []
    for i, p in enumerate(passages):  # two texts of one id, each of which a later document repeats
        texts += [p, f"x{i} " + common + " " + p[::-1]]
        ids += [i // 2, i // 2]
    texts += [p for p in passages] + [f"{common} {a} tail", f"{common} {b} tail"]
    ids += list(range(100, 100 + len(passages) + 2))
    got = collections.defaultdict(list)
    for r in substrings.removed(frame(spark, texts, ids=ids)).collect():
        got[r["doc_id"]].append((r["n_words"], r["n_removed"]))
    assert all(got[100 + i] == [(30, 30)] for i in range(8))
    assert got[108] == got[109] == [(22, 20)]
    first = min((ids[i], i) for i in range(16))[0]
    assert all(sorted(n for n, _ in got[i]) == sorted(len(texts[k].split()) for k in range(16) if ids[k] == i) for i in range(4)) and first == 0


def test_hashes_do_not_depend_on_what_is_around_or_on_blocks(monkeypatch):
    rng = np.random.default_rng(0)
    text = " ".join("".join(rng.choice(list("abé"), rng.integers(1, 9))) for _ in range(3000))
    alone = [words.hashes(pa.array([w]))[0][0] for w in text.split()]
    assert words.hashes(pa.array(["some first", text]))[0][2:].tolist() == alone
    h = np.array(alone)
    far = np.array([0, 5, words.BLOCK, words.BLOCK**2, 7 * words.BLOCK**2 + 3])
    assert words._power(12345, far).tolist() == [pow(12345, int(e), int(words.PRIME)) for e in far]
    at = np.arange(2900)
    whole = words.prints(h, at, at + 100)
    monkeypatch.setattr(words, "GROUP", words.BLOCK)
    assert words.hashes(pa.array([text * 9]))[0][:2999].tolist() == alone[:2999]
    assert all((words.prints(h[7:], at[:2800], at[:2800] + 100)[i] == whole[i][7:2807]).all() for i in (0, 1))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=12), max_size=4), st.lists(st.integers(0, 2), max_size=15))
def test_matching_statistics(sequences, query):
    a = substrings.SuffixAutomaton(sequences)
    parts = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    want = [max([n for n in range(1, e + 2) if tuple(query[e + 1 - n : e + 1]) in parts], default=0) for e in range(len(query))]
    assert a.statistics(query) == want


def test_references(spark):
    docs = frame(spark, ["keep this a b c d e and that", None, "nothing  here", ""])
    got = [r["text"] for r in substrings.without_references(docs, [["a b c d e"], ["zz"]], span=5).orderBy("doc_id").collect()]
    assert got == ["keep this and that", None, "nothing  here", ""]


# ---- neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 16)).astype(np.float32)
    x[10:30] = x[5]
    rows = [(i, [float(v) for v in r], "s") for i, r in enumerate(x)]
    rows += [(900, None, "s"), (950, [0.0] * 16, "s"), (1000, [math.nan] * 16, "s"), (1050, [1.0] * 3, "s"), (1100, [None] + [1.0] * 15, "s")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = collections.defaultdict(list)
    for r in ann.search(df, F.col("id") % 50 == 0, k=5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 600, 50):
        s = np.round(u @ u[q], 12)
        s[q] = -9
        want = np.lexsort((np.arange(600), -s))[:5]
        assert len(got[q]) == 5 and all(abs(score - u[v] @ u[q]) < 1e-9 for v, score in got[q])
        hits += len({v for v, _ in got[q]} & set(want.tolist()))
    assert hits >= 0.9 * 60 and set(got) == set(range(0, 600, 50))
    assert ann.search(df.filter("vec_id < 0"), F.col("id") % 50 == 0).count() == 0
    few = ann.search(df.filter("vec_id < 3"), F.col("id") % 50 == 0).orderBy("rank").collect()
    assert [r["rank"] for r in few] == [1, 2]


def test_outliers_among_tight_clusters_find_their_neighbours(spark):
    rng = np.random.default_rng(6)
    middle = rng.standard_normal((40, 16))
    x = np.concatenate([np.repeat(middle, 50, axis=0) + 0.01 * rng.standard_normal((2000, 16)), 3 * rng.standard_normal((10, 16))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.search(df, F.col("id") >= 2000, k=5, lists=60).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(2000, 2010):
        s = u @ u[q]
        s[q] = -9
        assert len(got[q]) == 5
        hits += len(set(got[q]) & set(np.argsort(-s)[:5].tolist()))
    assert hits >= 45


def test_repeated_candidates_all_count_and_one_odd_vector_changes_nothing(spark):
    rows = [(0, [1.0]), (1, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.1]), (2, [1.0, 0.1]), (3, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("id") == 1, k=5).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in got] == [(1, 2), (2, 2), (3, 3)]


# ---- language model


def test_scores(spark):
    texts = [t if t is None else t.upper() if i % 2 else t for i, t in enumerate(texts_with_copies())]
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    got = {r["doc_id"]: r for r in lm.score(frame(spark, texts), held).collect()}
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = {i: [*WORD.findall((t or "").translate(low)), "\n"] for i, t in enumerate(texts)}
    counts = collections.Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(base, abs=1e-6) and r["score"] < 0
    assert lm.score(frame(spark, []), held).count() == 0


def test_scores_tell_apart_infrequent_words_of_one_last_byte(spark):
    rng = np.random.default_rng(1)
    pairs = [f"a{i}x b{i}x" for i in range(200)]
    texts = [" ".join(pairs[i] for i in rng.permutation(200)) for _ in range(150)]
    right = [" ".join(pairs[i] for i in rng.permutation(200)[:50]) for _ in range(5)]
    wrong = [" ".join(f"a{i}x b{(i + 7) % 200}x" for i in rng.permutation(200)[:50]) for _ in range(5)]
    df = frame(spark, texts + right + wrong)
    got = {r["doc_id"]: r["score"] for r in lm.score(df, F.col("doc_id") >= 150).collect()}
    assert min(got[i] for i in range(150, 155)) > max(got[i] for i in range(155, 160)) + 20


def test_words_of_the_vocabulary_have_probabilities_that_sum_to_one():
    rng = np.random.default_rng(0)
    outputs = lm.Outputs(np.arange(1, 41, dtype=np.uint64), 10, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    values = rng.normal(0, 1, (2 + 40 + lm.TAIL + outputs.size + 30, lm.DIM + 1)).astype(np.float32)
    own = np.arange(40 + lm.TAIL)
    p = 10.0 ** lm.Model(outputs, values, np.ones(outputs.size + 30)).log10(np.full_like(own, 3), np.full_like(own, 20), own)
    assert p.sum() == pytest.approx(1, abs=1e-4)


def test_log_probabilities_are_normalised():
    rng = np.random.default_rng(0)
    k = 6
    table = lm.train(np.arange(k**3), rng.integers(1, 50, k**3).astype(float), k, steps=50)
    assert np.allclose((10.0 ** table.astype(float)).sum(axis=1), 1, atol=1e-4)


def plain_log10(m, two, one, own):
    """In double precision, from the formula."""
    o, v = m.outputs, m.values.astype(float)
    x = np.append(v[0, :-1] * v[2 + one, :-1] + v[1, :-1] * v[2 + two, :-1], 1.0)
    top = v[m.first_output : m.first_word] @ x
    t = int(o.of(np.array([own]))[0])
    out = top[t] - np.log(np.exp(top).sum())
    if o.heads <= own < len(o.vocabulary):
        begin, end = o.edges[t - o.heads], o.edges[t - o.heads + 1]
        s = v[m.first_word + begin : m.first_word + end] @ x
        out += s[own - o.heads - begin] - np.log(np.exp(s).sum())
    return out / np.log(10)


def test_log_probabilities_are_those_of_the_formula_however_many_at_a_time(monkeypatch):
    monkeypatch.setattr(lm, "AT_ONCE", 64)
    monkeypatch.setattr(lm, "BATCH", 32)
    rng = np.random.default_rng(5)
    outputs = lm.Outputs(np.arange(1, 201, dtype=np.uint64), 10, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    m = lm.Model(outputs, rng.normal(0, 0.7, (2 + 200 + lm.TAIL + outputs.size + 190, lm.DIM + 1)).astype(np.float32), np.ones(outputs.size + 190))
    two, one, own = rng.integers(0, 200 + lm.TAIL, (3, 700))
    assert np.allclose(m.log10(two, one, own), [plain_log10(m, *x) for x in zip(two, one, own, strict=True)], atol=1e-4)
    assert outputs.of(np.arange(10)).tolist() == list(range(10))
    assert all(outputs.edges[t - 10] <= place - 10 < outputs.edges[t - 9] for place, t in zip(range(10, 200), outputs.of(np.arange(10, 200)), strict=True))


def cpu(f, times=7):
    """Least CPU seconds of some calls."""
    took = []
    for _ in range(times):
        began = time.thread_time()
        f()
        took.append(time.thread_time() - began)
    return min(took)


def test_tokens_are_the_same_where_words_are_and_cost_less_than_polynomials():
    letters = "abcdefgh" * 80
    kinds = [letters[:n] for n in range(1, 600)] + [letters[: n - 1] + "z" for n in range(1, 600)] + [letters[1:n] for n in range(9, 600)]
    kinds += ["a" + "\0" * n for n in range(1, 20)] + ["\0" * n for n in range(1, 20)] + ["é", "É", " ", "ﬀ"]
    rng = np.random.default_rng(2)
    some = [kinds[i] for i in rng.integers(0, len(kinds), 4000)]
    texts = [" ".join(some[i : i + 50]).upper() if i % 100 else "\n".join(some[i : i + 50]) for i in range(0, len(some), 50)] + ["", " ", "a"]
    tokens, sizes = lm._tokens(pa.array(texts))
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    plain = [[*WORD.findall(t.translate(low)), "\n"] for t in texts]
    assert sizes.tolist() == [len(ws) for ws in plain]
    of = {}
    for w, h in zip((w for ws in plain for w in ws), tokens.tolist(), strict=True):
        assert of.setdefault(w, h) == h and (w == "\n" or h % lm.TAIL == w.encode()[-1] % lm.TAIL)
    assert len(set(of.values())) == len(of)

    english = pa.array([" ".join(f"{letters[i % 5 : i % 5 + n]}{i}" for i, n in enumerate(rng.integers(1, 8, 20_000).tolist()))])
    assert cpu(lambda: lm._tokens(english)) < 0.8 * cpu(lambda: words.hashes(english))


def test_sums_of_rows_cost_less_than_reducing_each():
    rng = np.random.default_rng(6)
    rows = np.concatenate([rng.integers(0, 40, 2000), 100 + (rng.pareto(0.6, 3500) * 30).astype(np.int64) % 80_000])
    values = rng.normal(size=(len(rows), lm.DIM + 1)).astype(np.float32)
    at, total, times = lm._sums(rows, values)
    right = np.zeros((rows.max() + 1, lm.DIM + 1))
    np.add.at(right, rows, values)
    assert (at == np.unique(rows)).all() and (times == np.unique(rows, return_counts=True)[1]).all() and np.allclose(total, right[at], atol=1e-3)

    def reduced():
        order = np.argsort(rows)
        r = rows[order]
        return np.add.reduceat(values[order], np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])), axis=0)

    assert cpu(lambda: lm._sums(rows, values), 30) < 0.8 * cpu(reduced, 30)
    assert all(len(x) == 1 for x in lm._sums(np.array([7]), np.ones((1, 3), np.float32)))


def test_texts_of_the_pilot_are_those_of_the_least_hashes_and_no_others_are_sent(spark, monkeypatch):
    monkeypatch.setattr(lm, "PILOT", 10)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(doc_id):
        seen.add(1)
        return f"text {doc_id}"

    ids = spark.range(0, 400, 1, 8).withColumn("doc_id", F.when(F.col("id") % 50 != 0, F.floor(F.col("id") / 2))).select("doc_id")
    got = [r["text"] for r in lm.pilot_texts(ids.withColumn("text", text("doc_id"))).collect()]
    right = ids.select("doc_id", F.xxhash64("doc_id").alias("at")).orderBy("at").limit(10).collect()
    assert sorted(got) == sorted(f"text {r['doc_id']}" for r in right)
    assert seen.value <= 20
    assert lm.pilot_texts(ids.filter("doc_id is null").withColumn("text", text("doc_id"))).count() == 8

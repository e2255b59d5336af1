"""Removing passages of ``span`` or more words that occur earlier in the corpus.

``without_references`` does this against given reference texts of bounded size: suffix automata of reference shards are broadcast,
and documents are streamed through them for matching statistics.

``repeats`` does it for a corpus against itself, where the references are all documents. Automata of the whole corpus cannot be
broadcast, so it first finds which passages can matter at all. Every window of ``span`` words has an anchor, the least hash of its
n-grams of ``GRAM`` words, so equal windows have equal anchors; consecutive windows of one anchor are a run. Runs whose anchor occurs
once are done with. Of runs with equal words, all but the first are repeats; tasks put equal runs of a slice of text in one row
before anything is shuffled, so that a passage in every document makes few rows. What is left are runs that share an anchor and
differ in some words: those of one anchor are a reference shard, whose suffix automaton is built run by run, in order of document and
start, each run being streamed through the automaton of the runs before it. Streaming through more than ``SHARD`` runs of an anchor
would make one task large, and splitting them into shards that each see all runs would cost their square; there, windows are keyed by
their whole words in place of their anchor, so that each window is a shard of its own. No run is left out either way.

Words are runs of anything but U+0020 and U+0009 to U+000D, held as hashes of 62 bits; runs and windows are compared by 124 bits.

Defined cases: null and empty texts have no words; texts shorter than the span lose nothing; of rows of one id each loses what also
starts in a document of smaller id, or at an earlier word of any row of its id; rows with a null id lose nothing and take nothing from others; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwright.llm import words
from siftwright.llm.common import ship, stored, text_or_empty

SPAN, GRAM, SHARD = 20, 5, 2048


class SuffixAutomaton:
    """Of several sequences. Lengths of matches with any of them come from one pass over a query."""

    def __init__(self, sequences: Iterable[list[int]] = ()) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for s in sequences:
            self.add(s)

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state of p's strings followed by c, apart from longer ones of q."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: Iterable[int]) -> None:
        last = 0
        for c in sequence:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
            last = new

    def statistics(self, query: Iterable[int]) -> list[int]:
        """For each place, the length of the longest match that ends there."""
        state = n = 0
        out = []
        for c in query:
            while state and c not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if (q := self.next[state].get(c)) is not None:
                state, n = q, n + 1
            else:
                n = 0
            out.append(n)
        return out


def without_references(docs: DataFrame, shards: list[list[str]], span: int = SPAN, most_words: int = 2_000_000) -> DataFrame:
    """docs with every match of span words or more with a reference text removed; kept words are joined by one space where anything
    was removed. shards: lists of texts; each shard's automaton is a broadcast of its own, of at most most_words words."""

    @F.pandas_udf("string")
    def clean(s, automata=None):  # noqa: ANN001, ANN202
        return s.map(one)

    def hashed(text: str) -> list[int]:
        return words.hashes(pa.array([text]))[0].tolist()

    spark = docs.sparkSession
    ship(spark)
    shared = []
    for shard in shards:
        sequences = [hashed(t) for t in shard]
        if sum(map(len, sequences)) > most_words:
            raise ValueError(f"a shard has more than {most_words} words")
        a = SuffixAutomaton(sequences)
        shared.append(spark.sparkContext.broadcast((a.next, a.link, a.length)))

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        gone: set[int] = set()
        h = hashed(text)
        for b in shared:
            a = SuffixAutomaton()
            a.next, a.link, a.length = b.value
            for end, n in enumerate(a.statistics(h)):
                if n >= span:
                    gone.update(range(end - n + 1, end + 1))
        if not gone:
            return text
        return b" ".join(w for i, w in enumerate(text.encode().split()) if i not in gone).decode()

    return docs.withColumn("text", clean("text"))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost least value among each width consecutive ones; width is a power of two."""
    at, step = np.arange(len(values)), 1
    while step < width:
        left, right = at[:-step], at[step:]
        at = np.where(values[left] <= values[right], left, right)
        step *= 2
    return at


def _runs(texts: pa.Array, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """For each run: text, start (word in the text), number of windows, hash of the anchor; and start among the words of all texts, with those words' hashes."""
    h, counts = words.hashes(texts)
    at = words.places(counts, span)
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none, none, none.astype(np.uint64), none, h
    grams = words.of_ranges(h, np.arange(len(h) - gram + 1), np.arange(gram, len(h) + 1))
    anchor = _least(grams, span - gram + 1)[at]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)])
    first = np.flatnonzero(new)
    n = np.diff(np.concatenate([first, [len(at)]]))
    start = at[first]
    ends = np.cumsum(counts)
    doc = np.searchsorted(ends, start, "right")
    return doc, start - (ends - counts)[doc], n, grams[anchor[first]], start, h


_PLACE = np.dtype([("doc_id", "<i8"), ("pos", "<i4")])
_RUN = [("anchor", pa.int64()), ("n", pa.int32()), ("p1", pa.int64()), ("p2", pa.int64())]
RUN_KEY = [name for name, _ in _RUN]


def _anchors(docs: DataFrame, span: int, gram: int) -> DataFrame:
    """a, c: how many runs have each anchor."""
    schema = pa.schema([("a", pa.int64()), ("c", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in words.in_parts(batch, 0):
                anchor, n = np.unique(_runs(b.column(0), span, gram)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(n)], schema=schema)

    return docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("text").mapInArrow(find, "a long, c long").groupBy("a").agg(F.sum("c").alias("c"))


def runs(docs: DataFrame, span: int, gram: int) -> DataFrame:
    """RUN_KEY, doc_id, pos, rest: equal runs of a slice of text in one row, with the first's place and, packed, those of the rest (null: none)."""
    schema = pa.schema([*_RUN, ("doc_id", pa.int64()), ("pos", pa.int32()), ("rest", pa.binary())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in words.in_parts(batch, 1):
                doc, pos, n, anchor, start, h = _runs(b.column(1), span, gram)
                if not len(doc):
                    continue
                p1, p2 = words.prints(h, start, start + n + span - 1)
                place = np.empty(len(doc), _PLACE)
                place["doc_id"], place["pos"] = b.column(0).to_numpy()[doc], pos
                order = np.lexsort((place["pos"], place["doc_id"], n, p2, p1))
                doc, n, anchor, p1, p2, place = (x[order] for x in (doc, n, anchor, p1, p2, place))
                new = np.concatenate([[True], (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1]) | (n[1:] != n[:-1]) | (anchor[1:] != anchor[:-1])])
                first = np.flatnonzero(new)
                more = np.diff(np.append(first, len(p1)))
                rest = np.full(len(first), None, object)
                for i in np.flatnonzero(more > 1).tolist():
                    rest[i] = place[first[i] + 1 : first[i] + more[i]].tobytes()
                as_long = lambda x: pa.array(x[first].view(np.int64))
                yield pa.RecordBatch.from_arrays([as_long(anchor), pa.array(n[first].astype(np.int32)), as_long(p1), as_long(p2), pa.array(place["doc_id"][first]), pa.array(place["pos"][first]), pa.array(rest, pa.binary())], schema=schema)

    kind = "anchor long, n int, p1 long, p2 long, doc_id long, pos int, rest binary"
    return docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").mapInArrow(find, kind)


_FOUND = pa.schema([("doc_id", pa.int64()), ("pos", pa.int32()), ("n", pa.int32()), ("print", pa.int64())])
FOUND = "doc_id long, pos int, n int, print long"


def _unpacked(rows: DataFrame) -> DataFrame:
    """FOUND for every place of rows (RUN_KEY, doc_id, pos, rest) after the first place of the run (first_doc, first_pos)."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc_id, pos, n, p1, first_doc, first_pos = (b.column(c).to_numpy() for c in ("doc_id", "pos", "n", "p1", "first_doc", "first_pos"))
            rest = b.column("rest").fill_null(b"")
            more = pc.binary_length(rest).to_numpy() // _PLACE.itemsize
            place = np.frombuffer(b"".join(rest.to_pylist()), _PLACE)
            row = np.concatenate([np.arange(len(n)), np.repeat(np.arange(len(n)), more)])
            doc, at = np.concatenate([doc_id, place["doc_id"]]), np.concatenate([pos, place["pos"]])
            later = (doc > first_doc[row]) | (doc == first_doc[row]) & (at > first_pos[row])
            row = row[later]
            yield pa.RecordBatch.from_arrays([pa.array(doc[later]), pa.array(at[later]), pa.array(n[row]), pa.array(p1[row])], schema=_FOUND)

    return rows.mapInArrow(spread, FOUND)


def _words_of(docs: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """wanted (RUN_KEY, doc_id, pos, many) with the hashes of each run's words. The text of an id is that in which the run is found."""
    lists = wanted.groupBy(F.col("doc_id").alias("d")).agg(F.collect_list(F.struct(*RUN_KEY, "pos", "many")).alias("runs"))
    schema = pa.schema([*_RUN, ("doc_id", pa.int64()), ("pos", pa.int32()), ("many", pa.bool_()), ("words", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in words.in_parts(batch, 1):
                h, counts = words.hashes(b.column(1))
                begin = np.cumsum(counts) - counts
                lists = b.column(2)
                doc = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
                anchor, n, p1, p2, pos, many = lists.flatten().flatten()
                start, size = begin[doc] + pos.to_numpy(), n.to_numpy() + span - 1
                fits = np.flatnonzero(pos.to_numpy() + size <= counts[doc])
                q1, q2 = words.prints(h, start[fits], start[fits] + size[fits])
                same = np.zeros(len(doc), bool)
                same[fits] = (q1.view(np.int64) == p1.to_numpy()[fits]) & (q2.view(np.int64) == p2.to_numpy()[fits])
                keep = pa.array(same)
                bodies = [h[s : s + z].tobytes() for s, z in zip(start[same].tolist(), size[same].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(x.filter(keep) for x in (anchor, n, p1, p2)), b.column(0).take(pa.array(doc[same])), pos.filter(keep), many.filter(keep), pa.array(bodies, pa.binary())], schema=schema)

    texts = docs.filter("text IS NOT NULL").select("doc_id", "text")
    kind = "anchor long, n int, p1 long, p2 long, doc_id long, pos int, many boolean, words binary"
    return texts.join(lists, texts["doc_id"] == lists["d"]).select("doc_id", "text", "runs").mapInArrow(cut, kind).dropDuplicates(RUN_KEY)


def _through_automata(shards: DataFrame, span: int) -> DataFrame:
    """FOUND for the windows that an earlier run of the same shard has."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, automaton = None, SuffixAutomaton()
        for b in batches:
            docs, places, firsts, sequences, size = [], [], [], [], 0
            for a, doc, pos, body in zip(*(b.column(c).to_pylist() for c in ("anchor", "doc_id", "pos", "words")), strict=True):
                if a != anchor:
                    anchor, automaton = a, SuffixAutomaton()
                sequence = np.frombuffer(body, np.uint64)
                as_list = sequence.tolist()
                found = np.flatnonzero(np.array(automaton.statistics(as_list)) >= span) - span + 1
                automaton.add(as_list)
                if len(found):
                    docs.append(np.full(len(found), doc, np.int64))
                    places.append(pos + found)
                    firsts.append(size + found)
                    sequences.append(sequence)
                    size += len(sequence)
            if docs:
                where, at = np.concatenate(places).astype(np.int32), np.concatenate(firsts)
                hashed = words.prints(np.concatenate(sequences), at, at + span)[0].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(docs)), pa.array(where), pa.array(np.ones(len(where), np.int32)), pa.array(hashed)], schema=_FOUND)

    dealt = shards.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "pos")
    return dealt.mapInArrow(stream, FOUND)


def _by_window(rows: DataFrame, span: int) -> DataFrame:
    """The same for anchors with many runs: a window is a repeat if the least (document, start) with its words is not its own."""
    schema = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column("n").to_numpy().astype(np.int64)
            h = np.frombuffer(b"".join(b.column("words").to_pylist()), np.uint64)
            at = words.places(n + span - 1, span)
            w1, w2 = words.prints(h, at, at + span)
            doc = np.repeat(np.arange(len(n)), n)
            shift = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), b.column("doc_id").take(pa.array(doc)), pa.array((b.column("pos").to_numpy()[doc] + shift).astype(np.int32))], schema=schema)

    windows = rows.mapInArrow(cut, "w1 long, w2 long, doc_id long, pos int")
    first = windows.groupBy(F.col("w1").alias("k1"), F.col("w2").alias("k2")).agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    return windows.join(first, F.expr("w1 = k1 AND w2 = k2")).filter(F.struct("doc_id", "pos") > F.col("first")).select("doc_id", "pos", F.lit(1).alias("n"), F.col("w1").alias("print"))


def repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """FOUND: n windows from word pos on, with their words' print, each of which starts earlier, too. Windows may come more than once."""
    if (span - gram + 1) & (span - gram):
        raise ValueError("span - gram + 1 must be a power of two")
    ship(docs.sparkSession)
    again = _anchors(docs, span, gram).filter("c > 1").select("a")
    every = runs(docs, span, gram)
    shared = stored(every.join(again, every["anchor"] == again["a"], "left_semi"))
    times = 1 + F.coalesce(F.octet_length("rest") / _PLACE.itemsize, F.lit(0)).cast("long")
    distinct = stored(shared.groupBy(*RUN_KEY).agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.sum(times).alias("c")))
    more = distinct.filter("c > 1").select(*RUN_KEY, F.col("first.doc_id").alias("first_doc"), F.col("first.pos").alias("first_pos"))
    copies = _unpacked(shared.join(more, RUN_KEY).select(*RUN_KEY, "doc_id", "pos", "rest", "first_doc", "first_pos"))
    mixed = distinct.groupBy(F.col("anchor").alias("a")).agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    wanted = distinct.join(mixed, distinct["anchor"] == mixed["a"]).select(*RUN_KEY, "first.doc_id", "first.pos", (F.col("k") > SHARD).alias("many"))
    passages = stored(_words_of(docs, stored(wanted), span))
    return copies.union(_through_automata(passages.filter("NOT many"), span)).union(_by_window(passages.filter("many"), span))


def removed(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space) and kept (those words) for each row of docs."""
    found = repeats(docs, span, gram).groupBy(F.col("doc_id").alias("d")).agg(*(F.collect_list(c).alias(c) for c in ("pos", "n", "print")))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def gone(texts: pa.Array, lists: list[pa.Array], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word of all texts whether it goes; and each text's number of words. Where an id has several rows, windows of another one, known by their print, don't count."""
        pos, n, prints = (x.flatten().to_numpy() for x in lists)
        counts = words.bounds(texts)[3]
        change = np.zeros(int(counts.sum()) + 1, np.int64)
        if len(pos):
            doc = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(lists[0]), 0).to_numpy(zero_copy_only=False))
            fits = pos + n + span - 1 <= counts[doc]
            if (several := np.flatnonzero(rows > 1)).size:
                h, few = words.hashes(texts.take(pa.array(several)))
                own = np.flatnonzero(fits & (rows[doc] > 1))
                start = (np.cumsum(few) - few)[np.searchsorted(several, doc[own])] + pos[own]
                fits[own] = words.prints(h, start, start + n[own] + span - 1)[0].view(np.int64) == prints[own]
            start = (np.cumsum(counts) - counts)[doc[fits]] + pos[fits]
            np.add.at(change, start, 1)
            np.add.at(change, start + n[fits] + span - 1, -1)
        return np.cumsum(change[:-1]) > 0, counts

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in words.in_parts(batch, 1):
                lost, counts = gone(b.column(1), b.columns[2:5], b.column(5).to_numpy())
                ends = np.cumsum(counts)
                removed = np.diff(np.concatenate([[0], np.cumsum(lost)])[np.concatenate([[0], ends])])
                bodies = []
                for text, n, end, some in zip(b.column(1), counts.tolist(), ends.tolist(), removed.tolist(), strict=True):
                    kept = text.as_buffer().to_pybytes().split()
                    if some:
                        kept = [kept[i] for i in np.flatnonzero(~lost[end - n : end]).tolist()]
                    bodies.append(b" ".join(kept))
                digests = [hashlib.sha256(x).hexdigest() for x in bodies]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests), pa.array(bodies, pa.binary())], schema=schema)

    ship(docs.sparkSession)
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    named = texts.filter("doc_id IS NOT NULL")
    # the join has sorted rows by id; those without one have nothing to join
    joined = named.join(found, named["doc_id"] == found["d"], "left").withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy("doc_id"))).select("doc_id", "text", "pos", "n", "print", "rows")
    joined = joined.unionByName(texts.filter("doc_id IS NULL").withColumn("rows", F.lit(1).cast("long")), allowMissingColumns=True)
    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary").withColumn("kept", F.decode("kept", "UTF-8"))

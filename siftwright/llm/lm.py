"""Scoring texts with a log-bilinear language model trained by noise-contrastive estimation.

Tokens are words, with A to Z in lower case, and an end after each text. The vocabulary is every token counted ``LEAST`` times or
more (from 100 million tokens on, a hundredth of the square root of their number), so it grows with the corpus but fits every worker,
and the ``HEAD`` most frequent in any case. Each of its words has a vector as context and one as
output. The two tokens before give the predicted vector, the sum of their vectors scaled by position; its product with an output's
vector, plus a bias, is the output's score. Probabilities are normalised in two steps: over the ``HEAD`` most frequent tokens, classes
of the other words of the vocabulary by frequency (about the square root of their number) and ``TAIL`` classes, by last byte, of all
rarer words; then over the words of the class. A rarer word's probability is that of its class times its smoothed share of the class.

Training contrasts outputs, and words among words, with noise drawn from their frequencies. Vectors start from a model of classes,
fitted on the triples of ``PILOT`` texts. Then every training text is read: in each of ``ROUNDS`` rounds, tasks train on their share of
the texts, and the changes of each vector are averaged over the tasks, weighted by how often they touched it.

Counts of words are exact for the whole corpus and live in a table keyed by 64-bit hashes. Those of the vocabulary, and of the most
frequent words, ``KNOWN`` at most, travel with the scoring task; the others are joined.

Defined cases: null and empty texts have the end as their only token; repeated rows count and are scored as rows; without training
texts, base and model give the end probability 1; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.llm import words
from siftwright.llm.common import ship, stored, text_or_empty

HEAD, TAIL, KNOWN = 32, 32, 500_000
#: The end's hash; the bits of a hash that are its tail class.
END, _TAILS = np.uint64(1), np.uint64(TAIL - 1)
DIM = 32
#: Least count of a word with vectors of its own, and its share of the square root of the corpus's tokens if that is more; texts of
#: the pilot; shares of the texts between averages.
LEAST, OF_ROOT, PILOT, ROUNDS = 100, 0.01, 2_000, 2
#: Tokens of a task's share, as a task that learns longer passes on fewer changes for each token; tasks at least.
TASK, TASKS = 8_000_000, 4
#: Tokens that a task holds, whose steps it shuffles; tokens of a step; a small corpus is repeated until about so many tokens are seen, AT_MOST times.
CHUNK, BATCH, ENOUGH, AT_MOST = 131_072, 2_048, 10_000_000, 12
#: Rows of parameters that travel together; scores taken at a time, as many as stay in a core's cache.
BLOCK, AT_ONCE = 64, 1 << 17

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Words of more bytes are hashed by polynomials. Bits of the first bytes of eight; what the hash of a word of so many bytes begins with.
LONG = 256
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_OF_SIZE = words.mix(np.arange(LONG + 1, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word, eight bytes at a time: most words are at an end after the first or the second."""
    sizes = ends - starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    out = words.mix(_OF_SIZE[np.minimum(sizes, LONG)] ^ (eights[starts] & _FIRST[np.minimum(sizes, 8)]))
    left = np.flatnonzero((sizes > 8) & (sizes <= LONG))
    for i in range(8, LONG, 8):
        if not len(left):
            break
        out[left] = words.mix(out[left] ^ (eights[starts[left] + i] & _FIRST[np.minimum(sizes[left] - i, 8)]))
        left = left[sizes[left] > i + 8]
    long = np.flatnonzero(sizes > LONG)
    if len(long):
        own = np.concatenate([data[a:z] for a, z in zip(starts[long], ends[long], strict=True)])
        to = np.cumsum(sizes[long])
        out[long] = words.of_bytes(own, to - sizes[long], to)
    return out


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token, its tail class in the low bits, an end after each text; and the number of tokens of each text."""
    data, starts, ends, counts = words.bounds(texts)
    low = _LOWER[data]
    h = _hashes(low, starts, ends) & ~_TAILS
    if len(ends):
        h |= low[ends - 1] & np.uint8(TAIL - 1)
    with_end = counts + 1
    total = int(with_end.sum())
    tokens = np.full(total, END)
    is_end = np.zeros(total, bool)
    is_end[np.cumsum(with_end) - 1] = True
    tokens[~is_end] = h
    return tokens, with_end


def count_words(docs: DataFrame, most: int = 1_000_000) -> DataFrame:
    """h, n: how often each token occurs. Tasks add up before they pass on, holding some ``most`` words at a time."""
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            h, n = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(h)
            h, n = h[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            return h[first], np.add.reduceat(n, first)

        def out(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], schema=schema)

        for batch in batches:
            for b in words.in_parts(batch, 0, 2 * words.AT_A_TIME):
                held.append(np.unique(_tokens(b.column(0))[0], return_counts=True))
                size += len(held[-1][0])
                if size > most:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > most // 2:
                        yield out(*held[0])
                        held, size = [], 0
        if held:
            yield out(*merged())

    ship(docs.sparkSession)
    return docs.select(text_or_empty().alias("text")).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


@dataclass
class Outputs:
    """Which output a token is. vocabulary: hashes by falling count, the first ``heads`` of them outputs of their own; known: hashes (sorted) and counts of the most frequent."""

    vocabulary: np.ndarray
    heads: int
    known: np.ndarray
    counts: np.ndarray

    def __post_init__(self) -> None:
        self.order = np.argsort(self.vocabulary)
        self.ordered = self.vocabulary[self.order]
        # by the top bits of a hash, where those with it begin; so few have the same that each is looked at
        bits = max(8, int(len(self.vocabulary)).bit_length() + 3)
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.ordered >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.most = int(np.diff(self.first).max())
        words = len(self.vocabulary) - self.heads
        # what a token costs is the number of outputs and the size of its class
        n = int(np.ceil(0.65 * words**0.5))
        # all of the vocabulary are known
        at = np.minimum(np.searchsorted(self.known, self.vocabulary), max(len(self.known) - 1, 0))
        self.own_counts = self.counts[at] if len(self.known) else np.zeros(len(self.vocabulary), np.int64)
        # frequent words are in small classes
        self.edges = np.unique(np.ceil(words * (np.arange(n + 1) / max(n, 1)) ** 2).astype(np.int64)) if words else np.zeros(1, np.int64)
        self.tops = np.concatenate([np.arange(self.heads), np.repeat(self.heads + np.arange(self.classes), np.diff(self.edges)), self.heads + self.classes + np.arange(TAIL)])

    @property
    def classes(self) -> int:
        return len(self.edges) - 1

    @property
    def size(self) -> int:
        return self.heads + self.classes + TAIL

    def place(self, tokens: np.ndarray) -> np.ndarray:
        """Rank in the vocabulary; for rarer words the size of the vocabulary and the tail class."""
        out = len(self.vocabulary) + (tokens & _TAILS).astype(np.int64)
        begin = self.first[(tokens >> self.shift).astype(np.int64)]
        left = np.arange(len(tokens))
        for i in range(self.most):
            at = np.minimum(begin + i, len(self.ordered) - 1)
            same = self.ordered[at] == tokens[left]
            out[left[same]] = self.order[at[same]]
            if i + 1 < self.most:
                left, begin = left[~same], begin[~same]
        return out

    def of(self, places: np.ndarray) -> np.ndarray:
        return self.tops[places]

    def count(self, tokens: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Of known tokens; -1 for others."""
        out = np.full(len(tokens), -1, np.int64)
        if not len(self.known):
            return out
        own = places < len(self.vocabulary)
        out[own] = self.own_counts[places[own]]
        rest = np.flatnonzero(~own)
        at = np.minimum(np.searchsorted(self.known, tokens[rest]), len(self.known) - 1)
        out[rest] = np.where(self.known[at] == tokens[rest], self.counts[at], -1)
        return out


def _contexts(outputs: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What stands two and one before each; the end (0) stands before a text."""
    one, two = np.zeros_like(outputs), np.zeros_like(outputs)
    one[1:], two[2:] = outputs[:-1], outputs[:-2]
    first = np.cumsum(sizes) - sizes
    one[first] = two[first] = 0
    two[(first + 1)[sizes > 1]] = 0
    return two, one


def count_triples(docs: DataFrame, outputs: Outputs) -> DataFrame:
    """triple (packed outputs), n."""
    k = outputs.size
    schema = pa.schema([("triple", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in words.in_parts(batch, 0):
                tokens, sizes = _tokens(b.column(0))
                if len(tokens):
                    o = outputs.of(outputs.place(tokens))
                    two, one = _contexts(o, sizes)
                    found, n = np.unique((two * k + one) * k + o, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], schema=schema)

    ship(docs.sparkSession)
    return docs.select(text_or_empty().alias("text")).mapInArrow(run, "triple long, n long").groupBy("triple").agg(F.sum("n").alias("n"))


def _sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, the sum of the values of each, and how many there are.

    Most rows occur once or a few times, and reduceat takes its time for each row, whatever there is to add; so it only gets the others."""
    order = np.argsort(rows)
    r = rows[order]
    first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    times = np.diff(np.append(first, len(r)))
    total = values.take(order[first], axis=0)
    often = times > 4
    if often.any():
        n = times[often]
        total[often] = np.add.reduceat(values.take(order[np.repeat(often, times)], axis=0), np.cumsum(n) - n, axis=0)
    left, i = np.flatnonzero((times > 1) & ~often), 1
    while len(left):
        total[left] += values.take(order[first[left] + i], axis=0)
        i += 1
        left = left[times[left] > i]
    return r[first], total, times


def fit(triples: np.ndarray, counts: np.ndarray, k: int, steps: int = 1500, batch: int = 4096, noise: int = 64, rate: float = 0.02, seed: int = 3) -> dict[str, np.ndarray]:
    """Vectors (one, out), scales and biases of a model of k outputs, from counts of triples."""
    rng = np.random.default_rng(seed)
    unigram = np.bincount(triples % k, counts, k) + 0.5
    unigram = unigram / unigram.sum()
    log_unigram = np.log(unigram)
    p = {"one": rng.normal(0, 0.1, (k, DIM)), "out": rng.normal(0, 0.1, (k, DIM)), "scale_one": np.ones(DIM), "scale_two": np.ones(DIM), "bias": log_unigram.copy()}
    p = {n: v.astype(np.float32) for n, v in p.items()}
    moments = {n: (np.zeros_like(v), np.zeros_like(v)) for n, v in p.items()}
    upto = np.cumsum(counts / counts.sum()) if len(counts) else np.zeros(0)
    noise_upto = np.cumsum(unigram)

    def scatter(index: np.ndarray, grad: np.ndarray) -> np.ndarray:
        out = np.zeros((k, grad.shape[1]), np.float32)
        rows, total, _ = _sums(index, grad)
        out[rows] = total
        return out

    for t in range(1, steps + 1 if len(counts) else 1):
        x = triples[np.minimum(np.searchsorted(upto, rng.random(batch)), len(triples) - 1)]
        two, one, w = x // (k * k), x // k % k, x % k
        bad = np.minimum(np.searchsorted(noise_upto, rng.random(noise)), k - 1)
        r1, r2 = p["one"][one], p["one"][two]
        predicted = p["scale_one"] * r1 + p["scale_two"] * r2
        shift = np.log(noise) + log_unigram
        true = (predicted * p["out"][w]).sum(axis=1) + p["bias"][w] - shift[w]
        false = predicted @ p["out"][bad].T + p["bias"][bad] - shift[bad]
        # derivative of the loss by the scores
        g = (-1 / (1 + np.exp(np.clip(true, -30, 30)))).astype(np.float32) / batch
        gf = (1 / (1 + np.exp(np.clip(-false, -30, 30)))).astype(np.float32) / batch
        gp = g[:, None] * p["out"][w] + gf @ p["out"][bad]
        grads = {
            "one": scatter(one, gp * p["scale_one"]) + scatter(two, gp * p["scale_two"]),
            "out": scatter(w, g[:, None] * predicted) + scatter(bad, gf.T @ predicted),
            "scale_one": (gp * r1).sum(axis=0),
            "scale_two": (gp * r2).sum(axis=0),
            "bias": np.bincount(w, g, k) + np.bincount(bad, gf.sum(axis=0), k),
        }
        step = rate * min(1.0, 2.0 * (1 - t / (steps + 1)))
        for n, grad in grads.items():
            m, v = moments[n]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            p[n] -= (step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return p


def train(triples: np.ndarray, counts: np.ndarray, k: int, steps: int = 1500) -> np.ndarray:
    """log10 probabilities [context, output] of fit, context = two * k + one, each row normalised."""
    p = fit(triples, counts, k, steps)
    table = np.empty((k * k, k), np.float32)
    for two in range(k):
        scores = (p["scale_one"] * p["one"] + p["scale_two"] * p["one"][two]) @ p["out"].T + p["bias"]
        scores = scores.astype(np.float64)
        top = scores.max(axis=1, keepdims=True)
        table[two * k : (two + 1) * k] = (scores - top - np.log(np.exp(scores - top).sum(axis=1, keepdims=True))) / np.log(10)
    return table


@dataclass
class Model:
    """values: a row for each of two scales, then for each context (the vocabulary, the tail classes), each output, and each word of a class; biases last."""

    outputs: Outputs
    values: np.ndarray
    unigram: np.ndarray

    def __post_init__(self) -> None:
        o = self.outputs
        self.first_output = 2 + len(o.vocabulary) + TAIL
        self.first_word = self.first_output + o.size
        self.n_words = len(o.vocabulary) - o.heads

    def predicted(self, two: np.ndarray, one: np.ndarray) -> np.ndarray:
        v = self.values
        x = np.empty((len(one), v.shape[1]), v.dtype)
        for lo in range(0, len(one), BATCH):
            part = v.take(2 + one[lo : lo + BATCH], axis=0)
            part *= v[0]
            more = v.take(2 + two[lo : lo + BATCH], axis=0)
            more *= v[1]
            np.add(part, more, out=x[lo : lo + BATCH])
        x[:, -1] = 1
        return x

    def learn(self, texts: Iterator[tuple[np.ndarray, np.ndarray]], repeat: int, rng: np.random.Generator, noise: int = 32, rate: float = 0.05) -> np.ndarray:
        """Changes values by every token of texts (places, and the number of tokens of each text); how often each row was touched.

        A step takes tokens that follow one another, so that a word's vector is read, and changed, once for the two tokens after it."""
        v, o = self.values, self.outputs
        power, hits = np.full(len(v), 0.1, np.float32), np.zeros(len(v), np.int64)
        shares = [self.unigram[: o.size], self.unigram[o.size :]]
        upto = [np.cumsum(x / x.sum()) for x in shares if len(x)]
        shift = np.concatenate([np.log(noise * x / x.sum()) for x in shares if len(x)]).astype(np.float32)

        def contrast(x: np.ndarray, target: np.ndarray, kind: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
            start = kind * o.size
            bad = start + np.minimum(np.searchsorted(upto[kind], rng.random(noise)), len(upto[kind]) - 1)
            out, out_bad = v.take(self.first_output + target, axis=0), v[self.first_output + bad]
            g = np.einsum("ij,ij->i", x, out) - shift[target]
            g = -1 / (1 + np.exp(np.clip(g, -30, 30)))
            gf = x @ out_bad.T
            np.subtract(shift[bad], gf, out=gf)
            np.clip(gf, -30, 30, out=gf)
            np.exp(gf, out=gf)
            gf += 1
            np.reciprocal(gf, out=gf)
            out *= g[:, None]
            out += gf @ out_bad
            return out, [self.first_output + target, self.first_output + bad], [g[:, None] * x, gf.T @ x]

        for own, sizes in texts:
            top = o.of(own)
            before = np.concatenate([[0, 0], own])  # the end stands before the first text, as between texts
            first = np.zeros(len(own), bool)
            first[np.cumsum(sizes) - sizes] = True
            for _ in range(repeat):
                cuts = np.arange(-int(rng.integers(BATCH)), len(own), BATCH)
                for lo in rng.permutation(cuts).tolist():
                    i = slice(max(lo, 0), min(lo + BATCH, len(own)))
                    n, fresh = i.stop - i.start, np.flatnonzero(first[i])
                    if n < 1:
                        continue
                    places = 2 + before[i.start : i.stop + 1]
                    both = v.take(places, axis=0)
                    r1, r2 = both[1:], both[:-1].copy()
                    r2[fresh] = r1[fresh]  # the end
                    x = r2 * v[1]
                    x += r1 * v[0]
                    x[:, -1] = 1
                    gp, rows, grads = contrast(x, top[i], 0)
                    inner = np.flatnonzero((own[i] >= o.heads) & (own[i] < len(o.vocabulary)))
                    if len(inner):
                        more, r, g = contrast(x.take(inner, axis=0), o.size + own[i][inner] - o.heads, 1)
                        more += gp.take(inner, axis=0)
                        gp[inner] = more
                        rows, grads = rows + r, grads + g
                    gp[:, -1] = 0
                    g2 = gp * v[1]
                    of_both = np.zeros_like(both)
                    np.multiply(gp, v[0], out=of_both[1:])
                    of_both[1 + fresh] += g2[fresh]
                    g2[fresh] = 0
                    of_both[:-1] += g2
                    of_scales = np.stack([np.einsum("ij,ij->j", gp, r) for r in (r1, r2)])
                    at, total, times = _sums(np.concatenate([[0, 1], places, *rows]), np.concatenate([of_scales, of_both, *grads]))
                    so_far = power[at] + np.einsum("ij,ij->i", total, total) / np.float32(total.shape[1])
                    power[at] = so_far
                    total *= (-rate / np.sqrt(so_far))[:, None]
                    total += v.take(at, axis=0)
                    v[at] = total
                    hits[at] += times
        return hits

    def top_sums(self, two: np.ndarray, one: np.ndarray) -> np.ndarray:
        """Logarithm of the sum of exp(score) over all outputs, after two and one. A score is a sum of what either gives, so exp is taken
        once for each distinct word before, and the sum is a product of two rows."""
        v, out = self.values, np.empty(len(one), np.float32)
        outputs = v[self.first_output : self.first_word]
        across = np.ascontiguousarray(outputs.T)
        rows, most, at = [], [], []
        few = max(16, AT_ONCE // len(outputs))
        for scale, words, bias in ((v[0], one, 0.0), (v[1], two, 1.0)):
            used = np.zeros(self.first_output - 2, bool)
            used[words] = True
            of_used = 2 + np.flatnonzero(used)
            s, high = np.empty((len(of_used), len(outputs)), np.float32), np.empty(len(of_used), np.float32)
            for lo in range(0, len(of_used), few):
                x, part = v.take(of_used[lo : lo + few], axis=0), s[lo : lo + few]
                x *= scale
                x[:, -1] = bias
                np.matmul(x, across, out=part)
                high[lo : lo + few] = part.max(axis=1)
                part -= high[lo : lo + few, None]
                np.exp(part, out=part)
            rows.append(s)
            most.append(high)
            at.append((np.cumsum(used) - 1)[words])
        for lo in range(0, len(one), few):
            i, j = at[0][lo : lo + few], at[1][lo : lo + few]
            out[lo : lo + few] = np.einsum("ij,ij->i", rows[0].take(i, axis=0), rows[1].take(j, axis=0))
        low = np.flatnonzero(out < 1e-25)  # what one favours, the other all but rules out
        out = np.log(np.maximum(out, 1e-37)) + most[0][at[0]] + most[1][at[1]]
        if len(low):
            s = self.predicted(two[low], one[low]) @ outputs.T
            top = s.max(axis=1, keepdims=True)
            out[low] = top[:, 0] + np.log(np.exp(s - top).sum(axis=1))
        return out

    def log10(self, two: np.ndarray, one: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Normalised log10 probability of each own token after two and one (places); for rarer words, of their class."""
        o, v = self.outputs, self.values
        top, x = o.of(own), self.predicted(two, one)
        outputs = v[self.first_output : self.first_word]
        out = -self.top_sums(two, one)
        for lo in range(0, len(own), BATCH):
            out[lo : lo + BATCH] += np.einsum("ij,ij->i", x[lo : lo + BATCH], outputs.take(top[lo : lo + BATCH], axis=0))
        out = out / np.log(10)

        words = v[self.first_word :]
        norms, own_norms = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", words, words)
        inner = np.flatnonzero((own >= o.heads) & (own < len(o.vocabulary)))
        # numbers of 16 bits are sorted by digits
        inner = inner[np.argsort(top[inner].astype(np.uint16 if o.size < 1 << 16 else np.int64), kind="stable")]
        cuts = np.searchsorted(top[inner], o.heads + np.arange(o.classes + 1))
        for c in np.flatnonzero(np.diff(cuts)):
            begin, end = o.edges[c], o.edges[c + 1]
            vectors, high = words[begin:end], float(own_norms[begin:end].max())
            few = max(16, AT_ONCE // (end - begin))
            for lo in range(cuts[c], cuts[c + 1], few):
                i = inner[lo : min(lo + few, cuts[c + 1])]
                s = x.take(i, axis=0) @ vectors.T
                if float(norms[i].max()) * high > 60.0**2:  # else exp stays in range
                    s -= s.max(axis=1, keepdims=True)
                mine = s[np.arange(len(i)), own[i] - o.heads - begin].astype(np.float64)
                out[i] += (mine - np.log(np.exp(s, out=s).sum(axis=1))) / np.log(10)
        return out


def start(pilot: dict[str, np.ndarray], outputs: Outputs, counts: np.ndarray, tail_counts: np.ndarray, seed: int = 4) -> Model:
    """Words begin with the context vectors of their outputs; words of classes as outputs with their share alone."""
    rng = np.random.default_rng(seed)
    places = np.arange(len(outputs.vocabulary) + TAIL)
    top = outputs.of(places)
    of_words = counts[outputs.heads :] + 0.5
    of_outputs = np.bincount(top, np.concatenate([counts, tail_counts]), outputs.size) + 0.5
    m = Model(outputs, np.zeros((2 + len(places) + outputs.size + len(of_words), DIM + 1), np.float32), np.concatenate([of_outputs, of_words]))
    m.values[0, :DIM], m.values[1, :DIM] = pilot["scale_one"], pilot["scale_two"]
    m.values[2 : m.first_output, :DIM] = pilot["one"][top] + rng.normal(0, 0.05, (len(places), DIM))
    m.values[m.first_output : m.first_word, :DIM] = pilot["out"]
    m.values[m.first_output : m.first_word, -1] = pilot["bias"]
    if len(of_words):
        m.values[m.first_word :, -1] = np.log(of_words / of_words.sum())
    return m


def improve(model: Model, docs: DataFrame, repeat: int, tasks: int) -> None:
    """One round: at most this many tasks learn from all rows of docs, beginning with the model; it takes the weighted mean of their changes."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    width = DIM + 1
    schema = pa.schema([("block", pa.int64()), ("n", pa.binary()), ("change", pa.binary())])

    def rows(blocks: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """Of each block, how often each row was touched, and the mean changes of those that were: half precision is 0.05 % of a change."""
        for lo in range(0, len(blocks), 256):
            at, n, change = zip(*blocks[lo : lo + 256], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([x.astype(np.int64).tobytes() for x in n]), pa.array([c[x > 0].astype(np.float16).tobytes() for x, c in zip(n, change, strict=True)])], schema=schema)

    def full(n: bytes, change: bytes) -> tuple[np.ndarray, np.ndarray]:
        times = np.frombuffer(n, np.int64)
        out = np.zeros((len(times), width), np.float32)
        out[times > 0] = np.frombuffer(change, np.float16).reshape(-1, width)
        return times, out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        begin = shared.value
        o, own = begin.outputs, Model(begin.outputs, begin.values.copy(), begin.unigram)

        def texts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            held, size = [], 0
            for batch in batches:
                for b in words.in_parts(batch, 0):
                    tokens, sizes = _tokens(b.column(0))
                    held.append((o.place(tokens), sizes))
                    size += len(tokens)
                    if size >= CHUNK:
                        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
                        held, size = [], 0
            if size:
                yield tuple(np.concatenate(c) for c in zip(*held, strict=True))

        hits = own.learn(texts(), repeat, np.random.default_rng(TaskContext.get().partitionId()))
        change = own.values - begin.values
        yield from rows([(i, hits[i : i + BLOCK], change[i : i + BLOCK]) for i in range(0, len(hits), BLOCK) if hits[i : i + BLOCK].any()])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, change = None, np.zeros(0), np.zeros(0)
        done: list[tuple[int, np.ndarray, np.ndarray]] = []
        for b in batches:
            for block, some, more in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if block != key:
                    if key is not None:
                        done.append((key, n, change / np.maximum(n, 1)[:, None]))
                    key, n, change = block, 0, 0.0
                times, moves = full(some.as_py(), more.as_py())
                n, change = n + times, change + moves * times[:, None]
            yield from rows(done)
            done = []
        if key is not None:
            yield from rows([(key, n, change / np.maximum(n, 1)[:, None])])

    kind = "block long, n binary, change binary"
    moved = docs.select(text_or_empty().alias("text")).coalesce(tasks).mapInArrow(run, kind)
    for b in moved.repartition("block").sortWithinPartitions("block").mapInArrow(add, kind).toArrow().to_batches():
        for block, n, change in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
            model.values[block : block + BLOCK] += full(n.as_py(), change.as_py())[1].astype(np.float32)
    shared.destroy()


def pilot_texts(training: DataFrame) -> DataFrame:
    """The texts, PILOT at most, whose ids have the least hashes. The last of these is found among hashes alone: else each partition would
    send so many texts to the one task that takes the least."""
    at = F.xxhash64("doc_id")
    last = training.select(at.alias("at")).orderBy("at").limit(PILOT).agg(F.max("at")).first()[0]
    return training.filter(at <= last).select("text", at.alias("at")).orderBy("at").limit(PILOT)


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text); learns from rows that aren't held out."""
    spark = docs.sparkSession
    training = docs.filter(~held_out)
    counted = stored(count_words(training))
    sums = counted.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_all, v_all = sums["n"] or 0, sums["v"]
    # how many words each step of counts has: some hundred rows, whatever the corpus
    step = F.floor(F.log2("n") * 16)
    steps = sorted(map(tuple, counted.groupBy(step.alias("step")).agg(F.count(F.lit(1))).collect()), reverse=True)
    fits = np.cumsum([n for _, n in steps]) <= KNOWN
    lowest = steps[int(fits.sum()) - 1][0] if fits.any() else np.inf
    least = max(LEAST, OF_ROOT * n_all**0.5)
    known = counted.filter((step >= float(lowest)) | (F.col("n") >= least) | (F.col("h") == int(END))).select("h", "n").toArrow()
    hashes, counts = (known.column(i).to_numpy().astype(np.int64) for i in range(2))
    order = np.lexsort((hashes, -counts))
    hashes, counts = hashes[order], counts[order]
    # the end first, then words by count: all of LEAST and more, HEAD - 1 at least
    is_end = hashes.view(np.uint64) == END
    words_ = np.flatnonzero(~is_end)
    own = words_[: max(int((counts[words_] >= least).sum()), HEAD - 1)]
    vocabulary = np.concatenate([[END], hashes[own].view(np.uint64)]).astype(np.uint64)
    own_counts, own_tails = np.concatenate([[counts[is_end].sum()], counts[own]]), (vocabulary & _TAILS).astype(np.int64)
    hashes = hashes.view(np.uint64)
    order = np.argsort(hashes)
    outputs = Outputs(vocabulary, min(HEAD, len(vocabulary)), hashes[order], counts[order])
    # size and number of words of each tail class, words of the vocabulary not among them
    by_tail = {r["tail"]: (r["n"], r["v"]) for r in counted.groupBy(F.col("h").bitwiseAND(TAIL - 1).alias("tail")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    class_n, class_v = (np.array([by_tail.get(i, (0, 0))[j] for i in range(TAIL)], np.int64) for j in (0, 1))
    class_n -= np.bincount(own_tails, own_counts, TAIL).astype(np.int64)
    class_v -= np.bincount(own_tails, own_counts > 0, TAIL).astype(np.int64)
    if n_all:
        counted_triples = count_triples(pilot_texts(training), outputs).toArrow()
        triples, times = (counted_triples.column(i).to_numpy() for i in (0, 1))
        order = np.argsort(triples)
        model = start(fit(triples[order], times[order].astype(np.float64), outputs.size), outputs, own_counts, class_n)
        del counted_triples, triples, times, order
        for r in range(ROUNDS):
            improve(model, training.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)) == r), max(1, min(AT_MOST, ENOUGH // n_all)), max(TASKS, -(-n_all // (ROUNDS * TASK))))
    else:
        model = None
    log_class = np.log10(class_n + 0.5 * (class_v + 1))
    log_all = float(np.log10(n_all + 0.5 * (v_all + 1)))
    shared = spark.sparkContext.broadcast((outputs, model))

    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("model", pa.float64()), ("rare", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        outputs, learned = shared.value
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for b in words.in_parts(batch, 2, 2 * words.AT_A_TIME):
                tokens, sizes = _tokens(b.column(2))
                o = outputs.place(tokens)
                two, one = _contexts(o, sizes)
                c = outputs.count(tokens, o)
                rare = c < 0
                doc = np.repeat(np.arange(len(sizes)), sizes)
                own = np.where(rare, 0.0, np.log10(np.maximum(c, 0) + 0.5))
                of_class = o >= len(outputs.vocabulary)
                model = learned.log10(two, one, o) if learned else np.where(o == 0, 0.0, -300.0)
                model = model + np.where(of_class, own - log_class[np.where(of_class, o - len(outputs.vocabulary), 0)], 0.0)
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc[rare], minlength=len(sizes)))])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(tokens[rare].view(np.int64)))
                add = lambda x: pa.array(np.bincount(doc, x, len(sizes)))
                ids = np.arange(rid, rid + len(sizes))
                rid += len(sizes)
                yield pa.RecordBatch.from_arrays([pa.array(ids), b.column(0), b.column(1), pa.array(sizes), pa.array(np.bincount(doc, c > 0, len(sizes)).astype(np.int64)), add(own - log_all), add(model), lists], schema=schema)

    scored = docs.select("doc_id", held_out.alias("held_out"), text_or_empty().alias("text")).mapInArrow(run, "rid long, doc_id long, held_out boolean, n_tokens long, known long, base double, model double, rare array<long>")
    scored = stored(scored)
    rare = scored.select("rid", F.explode("rare").alias("h"))
    counts_of = counted.select(F.col("h").alias("ch"), F.col("n").alias("c"))
    found = rare.join(counts_of, rare["h"] == counts_of["ch"], "left").groupBy(F.col("rid").alias("r")).agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"), F.count("c").alias("n_more"))
    more = F.coalesce("more", F.lit(0.0))
    return scored.drop("rare").join(found, scored["rid"] == found["r"], "left").select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("n_more", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score"))

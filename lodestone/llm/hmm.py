"""Hidden Markov language model.

Tokens: the words of a text (A-Z lower-cased, cut at ASCII white space), then
one end.  The base is the smoothed unigram ``(c + 0.1) / (N + 0.1 (V + 1))``
from the training documents.  The model is a hidden Markov chain of ``STATES``
states.  A state emits a class: one of the ``WORDS`` commonest words (of at
most ``WORD_BYTES`` bytes), the end, or for every other word, known or not, the
one of ``HASHED`` classes that its CRC-32 names; so the emission of any word
depends on the state, and the model has the same size for any vocabulary.
Among the words without a class of their own, a word is unknown with the
Good-Turing probability, those that occur once over all their tokens, and then
in any hashed class alike, in every state; else it is a known one, by its share
of the base within its class.  The unknown words of a class are one event.  So the model is a proper distribution
over texts, and a text's log probability is the chain's for its classes plus
one term per word without a class of its own, which needs no state.

Learning: counts of all words of all training documents, combined before the
shuffle; then ``ROUNDS`` rounds of Baum-Welch over all training documents,
whole texts.  Texts run in lockstep in pieces of ``PIECE`` tokens; scaled
products of the pieces' matrices give the exact forward and backward vectors at
each cut, and moves across it count like any other.  A task adds up expected
starts, moves and emissions, which are summed by blocks of classes across the
partitions, first by groups of about the square root of the number of tasks.
Emissions are smoothed by the base.

Scoring is exact over whole texts: the scaled forward recursion runs over the
stretches of a text in lockstep, each as a scaled matrix product, and chains
the products.  What words without a class of their own contribute is found by a
join of each text's distinct ones with the counts, not by a table in memory.

Defined cases: a null text counts as empty and is an end alone; a null id
counts as the empty text in the split; repeated rows are scored each; other
columns are ignored; without training documents all words are unknown and N and
V are 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import _groups, _types
from .common import shuffle_partitions, table, written

STATES = 6
ROUNDS = 5
#: Words with a class of their own, their largest size, and the classes of all others.
WORDS = 1 << 15
WORD_BYTES = 64
HASHED = 1 << 14
#: Tokens of a piece of a text in learning, and of a stretch in scoring.
PIECE = 512
STRETCH = 64
#: Weight of the base in a state's emissions, and of the prior in its moves, in tokens.
PRIOR = 20.0
MOVES = 1.0
#: The end as a token: no word holds a line feed.
END = "\n"
GROUP_CHARS = 2_000_000
#: Classes of a block of summed counts.
BLOCK = 4096
#: Pieces that run in lockstep.
TOGETHER = 1024


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of texts, every token's place among them, and the tokens' ends by text, all without the ends as tokens; a null counts as empty."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    found = split.flatten().dictionary_encode()
    words, places, ends = found.dictionary, found.indices.to_numpy(), split.offsets.to_numpy()
    empty = pc.index(words, "").as_py()  # beside white space at a text's ends
    if empty >= 0:
        kept = places != empty
        places, ends = places[kept], np.concatenate(([0], np.cumsum(kept)))[ends]
    return words, places, ends.astype(np.int64)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is 0 modulo 10."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def count_tokens(texts: DataFrame) -> DataFrame:
    """``token, n`` over all rows of ``texts(text)``, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _groups(batch.column(0), GROUP_CHARS):
                words, places, _ = _words(batch.column(0).slice(a, b - a))
                n = np.bincount(places, minlength=len(words))
                some = np.nonzero(n)[0]
                token = pa.concat_arrays([words.take(pa.array(some)), pa.array([END])])
                yield pa.RecordBatch.from_arrays([token, pa.array(np.append(n[some], b - a))], names=["token", "n"])

    return texts.mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


class Base:
    """The unigram over classes: words, then hashed classes, then the end."""

    def __init__(self, words: list[str], counts: np.ndarray, end: int, n: int, v: int, once: int, mass: np.ndarray) -> None:
        """``mass``: sums of ``c + 0.1`` over the known words of each hashed class."""
        self.words = words
        self.n, self.v = n, v
        self.total = n + 0.1 * (v + 1)
        self.mass = mass / self.total
        self.hashed = slice(len(words), len(words) + len(mass))
        self.end = self.hashed.stop
        self.end_known = end > 0
        unseen = 0.1 / self.total  # the base's one unknown event
        others = n - end - float(counts.sum())
        #: the unknown's share among the words without a class of their own
        self.rate = min(0.9, max(once, 1) / others) if others else 1.0
        weight = (1 - self.rate) * self.mass / max(self.mass.sum(), 1e-300) + self.rate / len(mass)
        self.unknown = self.rate / len(mass) / weight
        own = np.concatenate((counts + 0.1, [end + 0.1])) / self.total
        self.probs = np.concatenate((own[:-1], (self.mass.sum() + unseen) * weight, own[-1:]))
        if not n:  # nothing is known
            self.probs = np.concatenate((0.5 * weight, [0.5]))
        self.probs /= self.probs.sum()
        self.end_log10 = float(np.log10((end + 0.1) / self.total))
        #: what the hashed classes have together at least in every state
        self.least = min(0.5, max(once / max(n, 1), unseen))

    def log10(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / self.total)

    def class_terms(self) -> list[tuple[int, float, float]]:
        """Of each hashed class what a known word's base logarithm lacks, and an unknown word's logarithm."""
        known = np.log10(np.maximum(1 - self.unknown, 1e-300)) - np.log10(np.maximum(self.mass, 1e-300))
        return [(k, float(x), float(y)) for k, (x, y) in enumerate(zip(known, np.log10(self.unknown), strict=True))]


def _hashed_class(token: str, classes: int) -> Column:
    return (F.crc32(F.col(token).cast("binary")) % classes).cast("int")


def learn_base(counts: DataFrame, words: int | None = None, hashed: int | None = None) -> Base:
    """The base from ``counts(token, n)``; collects the commonest words and one sum for each hashed class."""
    hashed = hashed or HASHED
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.max(F.when(F.col("token") == END, F.col("n"))), F.lit(0)), F.count_if((F.col("n") == 1) & (F.col("token") != END))).first()
    common = counts.where((F.col("token") != END) & (F.octet_length("token") <= WORD_BYTES)).orderBy(F.desc("n"), "token").limit(words or WORDS)
    common = written(common, "hmm-words")
    others = counts.where(F.col("token") != END).join(F.broadcast(common.select("token")), "token", "left_anti")
    sums = others.groupBy(_hashed_class("token", hashed).alias("class")).agg(F.sum(F.col("n") + 0.1).alias("mass")).toArrow()
    mass = np.zeros(hashed)
    mass[sums["class"].to_numpy()] = sums["mass"].to_numpy()
    common = common.toArrow()
    return Base(common["token"].to_pylist(), common["n"].to_numpy().astype(np.float64), total[2], total[0], total[1], total[3], mass)


def number_texts(docs: DataFrame, base: Base) -> DataFrame:
    """``docs(doc_id, held_out, text)`` as ``row, doc_id, held_out, classes, others``: class numbers, and the distinct words without a class of their own."""
    shared = docs.sparkSession.sparkContext.broadcast(base.words)
    frame = docs.select("doc_id", "held_out", "text")
    first, hashed, end = base.hashed.start, len(base.mass), base.end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = pa.array(shared.value, pa.string())
        for batch in batches:
            for a, b in _groups(batch.column(2), GROUP_CHARS):
                words, places, ends = _words(batch.column(2).slice(a, b - a))
                number = np.array(pc.fill_null(pc.index_in(words, common), -1))
                rest = np.nonzero(number < 0)[0]
                texts, owner = np.arange(b - a + 1), np.repeat(np.arange(b - a), np.diff(ends))
                # a key for each text and word without a class of its own
                at = np.nonzero(number[places] < 0)[0]
                key, times = np.unique(owner[at] * len(words) + places[at], return_counts=True)
                other_ends = np.searchsorted(key, texts * len(words))
                number[rest] = [first + crc32(w.encode()) % hashed for w in words.take(pa.array(rest)).to_numpy(zero_copy_only=False)]
                classes = np.full(len(places) + b - a, end, np.int32)
                classes[np.arange(len(places)) + owner] = number[places]
                lists = pa.ListArray.from_arrays(pa.array((ends + texts).astype(np.int32)), pa.array(classes))
                left = pa.StructArray.from_arrays([words.take(pa.array(key % max(1, len(words)))), pa.array(times.astype(np.int32))], names=["token", "times"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), lists, pa.ListArray.from_arrays(pa.array(other_ends.astype(np.int32)), left)], names=["doc_id", "held_out", "classes", "others"])

    numbered = frame.mapInArrow(run, f"{_types(frame.select('doc_id', 'held_out'))}, classes array<int>, others array<struct<token string, times int>>")
    # the numbers of rows hold from here on, as the table is written
    return written(numbered.select(F.monotonically_increasing_id().alias("row"), "*"), "hmm-texts")


def _cut(ends: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Texts cut into parts of ``size`` tokens: of each its text, number, begin and length; and the texts' numbers of parts."""
    sizes = np.diff(ends)
    parts = -(-sizes // size)
    owner = np.repeat(np.arange(len(sizes)), parts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    return owner, number, ends[:-1][owner] + number * size, np.minimum(size, sizes[owner] - number * size), parts


def _lockstep(begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of parts by falling length, which take a token each at a time: where each step begins, and the tokens' places, step by step."""
    alive = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), side="left")  # parts longer than a step's number
    steps = np.concatenate(([0], np.cumsum(alive)))
    part = np.arange(steps[-1]) - np.repeat(steps[:-1], alive)
    return steps, begin[part] + np.repeat(np.arange(len(alive)), alive)


class Chain:
    """Start, moves and emissions: (state), (state, state), (class, state).

    Inside, states come first and parts of texts last, so that numpy's loops run over many parts.
    """

    def __init__(self, start: np.ndarray, moves: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.moves, self.emit = start, moves, emit

    @classmethod
    def first(cls, base: Base, states: int) -> Chain:
        rng = np.random.default_rng(17)
        emit = base.probs[:, None] * rng.gamma(2.0, size=(len(base.probs), states))
        moves = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
        return cls(np.full(states, 1.0 / states), moves, emit / emit.sum(axis=0))

    def _products(self, classes: np.ndarray, begin: np.ndarray, length: np.ndarray, first: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled products (from, to, part) of the matrices of each part's tokens, and the logarithms of the scales; a text's first token has no move before it."""
        k = len(self.start)
        order = np.argsort(-length, kind="stable")
        moves = self.moves.astype(emit.dtype)
        forward = np.ascontiguousarray(moves.T)
        products, scales = np.empty((k, k, len(order)), emit.dtype), np.zeros(len(order))
        for start in range(0, len(order), TOGETHER):
            own = order[start : start + TOGETHER]
            steps, at = _lockstep(begin[own], length[own])
            outs = np.take(emit, classes[at], axis=1)
            product = np.where(first[own], np.eye(k, dtype=emit.dtype)[:, :, None], moves[:, :, None]) * outs[:, : len(own)]
            moved, scale = np.empty_like(product), np.zeros(len(own))
            for t in range(len(steps) - 1):
                n = steps[t + 1] - steps[t]
                now = product[:, :, :n]
                if t:
                    np.multiply(np.matmul(forward, now, out=moved[:, :, :n]), outs[:, steps[t] : steps[t + 1]], out=now)
                if t % 8 == 7 or t == len(steps) - 2:
                    top = now.max(axis=(0, 1))
                    now /= top
                    scale[:n] += np.log(top)
            products[:, :, own], scales[own] = product, scale
        return products, scales

    def log_likelihoods(self, classes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probabilities of all texts ``classes[ends[i]:ends[i + 1]]``."""
        _, number, begin, length, stretches = _cut(ends, STRETCH)
        product, scale = self._products(classes, begin, length, number == 0, np.ascontiguousarray(self.emit.T))
        total = np.zeros(len(stretches))
        state = np.repeat(self.start[:, None], len(stretches), axis=1)
        firsts = np.cumsum(stretches) - stretches
        by_length = np.argsort(-stretches, kind="stable")
        for step in range(int(stretches.max(initial=0))):
            texts = by_length[: int(np.searchsorted(-stretches[by_length], -step, side="left"))]
            at = firsts[texts] + step
            now = np.einsum("jn,jln->ln", state[:, texts], product[:, :, at])
            top = now.sum(axis=0)
            state[:, texts] = now / top
            total[texts] += np.log(top) + scale[at]
        return total

    def expect(self, classes: np.ndarray, ends: np.ndarray, sums: Sums) -> None:
        """Adds the expected counts of the texts to ``sums``."""
        owner, number, begin, length, parts = _cut(ends, PIECE)
        k = len(self.start)
        emit = np.ascontiguousarray(self.emit32().T)
        before = np.zeros((k, len(owner)), np.float32)  # the state before a piece, but for the first of a text
        after = np.ones((k, len(owner)), np.float32)  # what comes behind a piece, given its last state
        several = np.nonzero(parts[owner] > 1)[0]
        if len(several):
            product = np.zeros((k, k, len(owner)), np.float32)
            product[:, :, several] = self._products(classes, begin[several], length[several], number[several] == 0, emit)[0]
            firsts = np.cumsum(parts) - parts
            for step in range(1, int(parts.max())):
                texts = np.nonzero(parts > step)[0]
                at = firsts[texts] + step
                now = np.repeat(self.start[:, None].astype(np.float32), len(at), axis=1) if step == 1 else before[:, at - 1]
                now = np.einsum("jn,jln->ln", now, product[:, :, at - 1])
                before[:, at] = now / now.sum(axis=0)
                at = firsts[texts] + parts[texts] - step
                now = np.einsum("jln,ln->jn", product[:, :, at], after[:, at])
                after[:, at - 1] = now / now.max(axis=0)
        order = np.argsort(-length, kind="stable")
        for at in range(0, len(order), TOGETHER):
            own = order[at : at + TOGETHER]
            self._expect(classes, begin[own], length[own], number[own] == 0, before[:, own], after[:, own], emit, sums)

    def _expect(self, classes: np.ndarray, begin: np.ndarray, length: np.ndarray, first: np.ndarray, before: np.ndarray, after: np.ndarray, emit: np.ndarray, sums: Sums) -> None:
        k, n = before.shape
        steps, at = _lockstep(begin, length)
        own = classes[at].astype(np.intp)
        outs = np.take(emit, own, axis=1)
        moves = self.moves.astype(np.float32)
        forward = np.ascontiguousarray(moves.T)
        alpha = np.empty_like(outs)
        moved = np.where(first, self.start[:, None].astype(np.float32), forward @ before)
        for t in range(len(steps) - 1):
            a, b = steps[t], steps[t + 1]
            if t:
                np.matmul(forward, alpha[:, steps[t - 1] : steps[t - 1] + b - a], out=moved[:, : b - a])
            now = alpha[:, a:b]
            np.multiply(moved[:, : b - a], outs[:, a:b], out=now)
            now /= np.add.reduce(now, axis=0)
        beta = np.ones((k, 0), np.float32)
        pair = np.zeros((k, k))
        for t in range(len(steps) - 2, -1, -1):
            a, b, on = steps[t], steps[t + 1], beta.shape[1]
            here, now = np.empty((k, b - a), np.float32), alpha[:, a:b]
            here[:, on:] = after[:, on : b - a]
            if on:
                follow = beta * outs[:, b : b + on]
                np.matmul(moves, follow, out=here[:, :on])
            norm = np.add.reduce(now * here, axis=0)
            if on:
                pair += (now[:, :on] / norm[:on]) @ follow.T
            beta = np.divide(here, norm, out=here)
            now *= beta  # the states' weights from here on
        inner = ~first
        if inner.any():  # the moves into the pieces
            follow = beta[:, inner] * outs[:, :n][:, inner]
            norm = (before[:, inner] * (moves @ follow)).sum(axis=0)
            pair += (before[:, inner] / norm) @ follow.T
        sums.pair += pair * self.moves
        sums.start += alpha[:, :n][:, first].sum(axis=1)
        sums.add(own, alpha)

    def emit32(self) -> np.ndarray:
        # scaled, as rows of small numbers lose no digits that a ratio needs
        return (self.emit / self.emit.max(axis=1, keepdims=True)).astype(np.float32)

    @classmethod
    def from_sums(cls, sums: Sums, base: Base) -> Chain:
        k = len(sums.start)
        moves = sums.pair + MOVES / k
        emit = sums.emit + PRIOR * base.probs[:, None]
        emit /= emit.sum(axis=0)
        hashed = emit[base.hashed].sum(axis=0)
        want = np.maximum(hashed, base.least)
        block = want * ((1 - base.rate) * emit[base.hashed] / hashed + base.rate / len(base.mass))
        emit *= (1 - want) / np.maximum(1 - hashed, 1e-300)
        emit[base.hashed] = block
        start = sums.start + MOVES / k
        return cls(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


class Sums:
    """Expected counts."""

    def __init__(self, classes: int, states: int) -> None:
        self.start, self.pair = np.zeros(states), np.zeros((states, states))
        self.emit = np.zeros((classes, states))

    def add(self, classes: np.ndarray, weights: np.ndarray) -> None:
        """Emissions of ``classes`` by their weights (state, token)."""
        for s, own in enumerate(weights):
            self.emit[:, s] += np.bincount(classes, own, minlength=len(self.emit))


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and ends of a list column without nulls."""
    ends = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[ends[0] : ends[-1]], ends - ends[0]


def _slices(column: pa.ListArray, limit: int = 500_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` tokens, one row at least."""
    ends = column.offsets.to_numpy().astype(np.int64)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
        yield at, min(to, len(column))
        at = to


def _sums_batch(rows: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in rows.values()], pa.binary())], names=["block", "sums"])


def baum_welch(texts: DataFrame, base: Base, states: int = STATES, rounds: int = ROUNDS) -> Chain:
    """The chain after ``rounds`` rounds over all of ``texts(classes)``."""
    spark = texts.sparkSession
    classes = len(base.probs)
    chain = Chain.first(base, states)
    blocks = -(-classes // BLOCK)
    own = texts.select("classes")
    fans = max(1, isqrt(own.rdd.getNumPartitions()))
    parts = shuffle_partitions(spark)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(chain)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            now, sums = shared.value, Sums(classes, states)
            for batch in batches:
                for a, b in _slices(batch.column(0)):
                    now.expect(*_lists(batch.column(0).slice(a, b - a)), sums)
            if sums.start.any():
                yield _sums_batch({-1: np.concatenate((sums.start, sums.pair.ravel()))} | {k: sums.emit[k * BLOCK : (k + 1) * BLOCK].ravel() for k in range(blocks)})

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    part = np.frombuffer(x.as_buffer(), np.float32)
                    total[k] = total.get(k, 0.0) + part.astype(np.float64)
            if total:
                yield _sums_batch(total)

        # in two steps, so that no task meets the sums of all others
        each = own.mapInArrow(expect, "block int, sums binary").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(fans)))
        some = each.repartition(parts, "part", "block").select("block", "sums").mapInArrow(add, "block int, sums binary")
        summed = some.repartition(min(blocks + 1, parts), "block").mapInArrow(add, "block int, sums binary").toArrow()
        sums = Sums(classes, states)
        for k, x in zip(summed["block"].to_pylist(), summed["sums"].to_pylist(), strict=True):
            part = np.frombuffer(x, np.float32).astype(np.float64)
            if k < 0:
                sums.start, sums.pair = part[:states], part[states:].reshape(states, states)
            else:
                sums.emit[k * BLOCK : (k + 1) * BLOCK] = part.reshape(-1, states)
        if not sums.start.any():
            break
        chain = Chain.from_sums(sums, base)
    return chain


def score_texts(texts: DataFrame, counts: DataFrame, base: Base, chain: Chain) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of :func:`number_texts`."""
    shared = texts.sparkSession.sparkContext.broadcast((base, chain))
    frame = texts.select("row", "doc_id", "held_out", "classes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, chain = shared.value
        # words without a class of their own are added after the join
        log_base, known = np.log10(base.probs), np.ones(len(base.probs), dtype=np.int64)
        log_base[base.hashed], known[base.hashed] = 0.0, 0
        log_base[base.end], known[base.end] = base.end_log10, int(base.end_known)
        for batch in batches:
            for a, b in _slices(batch.column(3)):
                part = batch.slice(a, b - a)
                classes, ends = _lists(part.column(3))
                score = chain.log_likelihoods(classes, ends) / np.log(10)
                firsts = ends[:-1]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(np.diff(ends)), pa.array(np.add.reduceat(known[classes], firsts)), pa.array(np.add.reduceat(log_base[classes], firsts)), pa.array(score)],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    scored = frame.mapInArrow(run, f"{_types(frame.drop('classes'))}, n_tokens long, n_known long, base_score double, score double")
    words = texts.select("row", F.explode("others").alias("other")).select("row", "other.token", "other.times")
    terms = texts.sparkSession.createDataFrame(base.class_terms(), "class int, known double, unknown double")  # a row for each hashed class
    seen = F.col("n") > 0
    found = words.join(counts, "token", "left").withColumn("class", _hashed_class("token", len(base.mass))).join(F.broadcast(terms), "class").groupBy("row").agg(
        F.sum(F.when(seen, F.col("times")).otherwise(0)).alias("known_others"),
        F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.1) / F.lit(base.total))).alias("others_base"),
        F.sum(F.col("times") * F.when(seen, F.log10((F.col("n") + 0.1) / F.lit(base.total)) + F.col("known")).otherwise(F.col("unknown"))).alias("others_score"),
    )
    both = scored.join(found, "row", "left")
    known, others_base, others_score = (F.coalesce(c, F.lit(0)) for c in ("known_others", "others_base", "others_score"))
    return both.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + known).cast("long").alias("n_known"),
        F.lit(base.n).cast("long").alias("train_tokens"),
        (F.col("base_score") + others_base).alias("base_score"),
        (F.col("score") + others_score).alias("score"),
    )


def score_documents(docs: DataFrame) -> DataFrame:
    """Learns from the rows that aren't held out and scores all rows of ``docs(doc_id, held_out, text)``."""
    counts = written(count_tokens(docs.where("NOT held_out").select("text")), "hmm-counts")
    base = learn_base(counts)
    texts = number_texts(docs, base)
    chain = baum_welch(texts.where("NOT held_out"), base)
    return score_texts(texts, counts.where(F.col("token") != END), base, chain)


def op4_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``."""
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", held_out().alias("held_out"), "text"))

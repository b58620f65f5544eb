"""Language identification by segmentation-marginalised unigrams.

Every language has a unigram distribution over the pieces of a fixed public
vocabulary.  The probability of a word is the sum over all of its
segmentations into pieces, by the forward algorithm; a text's is the product
over its words (runs of letters, lower-cased, with the mark of a word start).
Words of up to ``WORD_CHARS`` letters are worked through together; longer ones
one by one and in logarithms, with the last positions only in memory.  A letter
that no piece covers is a piece of its own, shared by all such letters.  Languages have equal priors; the score
of a prediction is its posterior probability.

The piece probabilities are the maximum-likelihood ones under that model,
found by expectation-maximisation from one common start and smoothed towards
the mean of the languages.  They are fitted on a bounded sample of labelled
rows: of each language, the rows whose hash lies below SAMPLE / (its rows), so
about SAMPLE rows; from those whole texts.  Every language that a labelled row
names is learned; the model in memory is the table of pieces by languages.
Prediction runs over all rows and whole texts, and no column but the text is
read for it.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
so is any text if no labelled row with letters exists; ties go to the smaller
language name; null languages teach nothing; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import _clean, _groups, _types, public_path
from .common import releasing, table, written
from .pieces import normal_pieces

MARK = "▁"
LETTERS = re.compile(r"[^\W\d_]+")
#: Letters up to which the probability of a word is far above the smallest double.
WORD_CHARS = 16
SAMPLE = 3000
ROUNDS = 3
#: Weight of the languages' mean in a language's distribution, in pieces.
PRIOR = 200.0
#: Probability of one certain letter among those without a piece.
ONE_LETTER = 1e-5
#: Words whose lattices are worked through together, and words a worker remembers.
TOGETHER = 8192
REMEMBERED = 300_000
GROUP_CHARS = 2_000_000


def words_of(text: str) -> list[str]:
    found = LETTERS.findall(text.lower())
    if not all(map(str.isalpha, found)):  # digits that are no decimals, as in x²
        found = [w for x in found if (w := "".join(filter(str.isalpha, x)))]
    return found


class Pieces:
    """Numbers of the pieces; one more stands for any letter without a piece."""

    def __init__(self, path: str) -> None:
        names = [p for p, _ in normal_pieces(path)]
        self.number = {p: k for k, p in enumerate(names)}
        self.size = len(names) + 1
        #: pieces by number, and -1 for what only begins a piece
        self.begins = dict.fromkeys((p[:k] for p in names for k in range(1, len(p))), -1) | self.number
        self.longest = max(map(len, names), default=1)
        self.weight = np.ones(self.size)
        self.weight[-1] = ONE_LETTER


def edges_of(token: str, begins: dict[str, int], unknown: int) -> Iterator[tuple[int, int, int]]:
    """All pieces (start, end, number) in a word, by start; a letter that is no piece counts as ``unknown``."""
    size = len(token)
    for i in range(size):
        p = begins.get(token[i], -2)
        yield i, i + 1, p if p >= 0 else unknown
        if p > -2:
            for j in range(i + 2, size + 1):
                p = begins.get(token[i:j], -2)
                if p >= 0:
                    yield i, j, p
                elif p == -2:
                    break


class LongWord:
    """All segmentations of one word of any length, in logarithms."""

    def __init__(self, pieces: Pieces, word: str) -> None:
        self.pieces, self.token = pieces, MARK + word

    def _steps(self) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        for i, edges in groupby(edges_of(self.token, self.pieces.begins, self.pieces.size - 1), key=lambda e: e[0]):
            yield i, list(edges)

    def forward(self, logs: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int, int]], np.ndarray]]:
        """Position, the edges from it, and the logarithms of the sums over what comes before it; at last the word's."""
        ahead = {0: np.zeros(logs.shape[1])}
        for i, edges in self._steps():
            here = ahead.pop(i)
            yield i, edges, here
            for _, j, p in edges:
                ahead[j] = np.logaddexp(ahead[j], here + logs[p]) if j in ahead else here + logs[p]
        yield len(self.token), [], ahead[len(self.token)]

    def total(self, logs: np.ndarray) -> np.ndarray:
        for _, _, here in self.forward(logs):
            pass
        return here

    def add_expected(self, logs: np.ndarray, counts: np.ndarray, uses: np.ndarray) -> None:
        """Adds the expected uses (piece, language) for counts (language)."""
        steps = list(self.forward(logs))
        whole = steps[-1][2]
        after = {len(self.token): np.zeros(logs.shape[1])}
        for i, edges, here in reversed(steps[:-1]):
            sums = [logs[p] + after[j] for _, j, p in edges]
            for (_, _, p), x in zip(edges, sums, strict=True):
                uses[p] += counts * np.exp(here + x - whole)
            after[i] = np.logaddexp.reduce(sums)
            after.pop(i + self.pieces.longest, None)


class Lattices:
    """All segmentations of some words, as edges (word, start, end, piece)."""

    def __init__(self, pieces: Pieces, words: list[str]) -> None:
        begins, unknown = pieces.begins, pieces.size - 1
        word: list[int] = []
        start: list[int] = []
        end: list[int] = []
        piece: list[int] = []
        for w, text in enumerate(words):
            for i, j, p in edges_of(MARK + text, begins, unknown):
                word.append(w)
                start.append(i)
                end.append(j)
                piece.append(p)
        self.n = len(words)
        self.word, self.start, self.end, self.piece = (np.array(x, dtype=np.int64) for x in (word, start, end, piece))
        self.sizes = np.array([len(w) + 1 for w in words], dtype=np.int64)

    def _steps(self, by: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Edges that meet at each position, with the words and their first edges."""
        order = np.lexsort((self.word, by))
        out = []
        for part in np.split(order, np.nonzero(np.diff(by[order]))[0] + 1):
            firsts = np.concatenate(([0], np.nonzero(np.diff(self.word[part]))[0] + 1))
            out.append((part, self.word[part][firsts], firsts))
        return out

    def forward(self, probs: np.ndarray) -> np.ndarray:
        """Forward sums (word, position, language); probs: (piece, language)."""
        alpha = np.zeros((self.n, int(self.sizes.max()) + 1, probs.shape[1]))
        alpha[:, 0] = 1
        for edges, words, firsts in self._steps(self.end):
            at = int(self.end[edges[0]])
            alpha[words, at] = np.add.reduceat(alpha[self.word[edges], self.start[edges]] * probs[self.piece[edges]], firsts, axis=0)
        return alpha

    def totals(self, alpha: np.ndarray) -> np.ndarray:
        return alpha[np.arange(self.n), self.sizes]

    def expected(self, probs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses (piece, language) for counts (word, language)."""
        alpha = self.forward(probs)
        beta = np.zeros_like(alpha)
        beta[np.arange(self.n), self.sizes] = 1
        for edges, words, firsts in reversed(self._steps(self.start)):
            at = int(self.start[edges[0]])
            beta[words, at] = np.add.reduceat(beta[self.word[edges], self.end[edges]] * probs[self.piece[edges]], firsts, axis=0)
        scale = counts / self.totals(alpha)
        uses = alpha[self.word, self.start] * probs[self.piece] * beta[self.word, self.end] * scale[self.word]
        return np.stack([np.bincount(self.piece, uses[:, k], minlength=len(probs)) for k in range(probs.shape[1])], axis=1)


def word_scores(pieces: Pieces, words: list[str], probs: np.ndarray) -> np.ndarray:
    """Log probabilities (word, language) of words of any length; ``probs``: (piece, language)."""
    out = np.empty((len(words), probs.shape[1]))
    many = np.fromiter((len(w) > WORD_CHARS for w in words), bool, len(words))
    short = np.nonzero(~many)[0]
    for at in range(0, len(short), TOGETHER):
        part = short[at : at + TOGETHER]
        lattices = Lattices(pieces, [words[k] for k in part])
        out[part] = np.log(lattices.totals(lattices.forward(probs)))
    if many.any():
        logs = np.log(probs)
        for k in np.nonzero(many)[0]:
            out[k] = LongWord(pieces, words[k]).total(logs)
    return out


def expected_uses(pieces: Pieces, words: list[str], counts: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """Expected uses (piece, language) in words of any length; ``counts``: (word, language)."""
    many = np.fromiter((len(w) > WORD_CHARS for w in words), bool, len(words))
    short = np.nonzero(~many)[0]
    uses = Lattices(pieces, [words[k] for k in short]).expected(probs, counts[short]) if len(short) else np.zeros_like(probs)
    if many.any():
        logs = np.log(probs)
        for k in np.nonzero(many)[0]:
            LongWord(pieces, words[k]).add_expected(logs, counts[k], uses)
    return uses


class Model:
    """Languages and the probability of every piece in each of them."""

    def __init__(self, path: str, languages: list[str], probs: np.ndarray) -> None:
        self.path, self.languages, self.probs = path, languages, probs

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Predicts texts; remembers the scores of words."""

    def __init__(self, model: Model) -> None:
        self.languages = model.languages
        self.pieces = Pieces(model.path)
        self.probs = model.probs * self.pieces.weight[:, None]
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores and log likelihoods (text, language)."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros((len(texts), 0))
        rows = [words_of(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.scores = {}, self.scores[:0]
        new = list({w for row in rows for w in row if w not in self.known})
        self.scores = np.concatenate((self.scores, word_scores(self.pieces, new, self.probs)))
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        total = np.zeros((len(texts), len(self.languages)))
        for k, row in enumerate(rows):
            if row:
                total[k] = self.scores[np.fromiter(map(self.known.__getitem__, row), np.int64, len(row))].sum(axis=0)
        posterior = np.exp(total - total.max(axis=1, keepdims=True))
        posterior /= posterior.sum(axis=1, keepdims=True)
        best = posterior.argmax(axis=1)
        some = np.array([bool(r) for r in rows], dtype=bool)
        return [self.languages[b] if s else "und" for b, s in zip(best, some, strict=True)], np.where(some, posterior.max(axis=1), 0.0), total


def _sample(labelled: DataFrame, sample: int) -> tuple[DataFrame, list[str]]:
    """About ``sample`` rows of each language, by a hash of the text."""
    spark = labelled.sparkSession
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row for each language
    names = sorted(r.lang for r in sizes)
    kept = spark.createDataFrame([(r.lang, min(1.0, sample / r.n)) for r in sizes] or [], "lang string, share double")
    part = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return labelled.join(F.broadcast(kept), "lang").where(part < F.col("share")).select("lang", "text"), names


def train(labelled: DataFrame, path: str, sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """The model from ``labelled(lang, text)``; null languages and texts teach nothing."""
    rows, names = _sample(labelled.where("lang IS NOT NULL AND text IS NOT NULL"), sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _groups(batch.column(1), GROUP_CHARS):
                seen: Counter[tuple[str, str]] = Counter()
                for lang, text in zip(batch.column(0).slice(a, b - a).to_pylist(), _clean(batch.column(1).slice(a, b - a)), strict=True):
                    for w, n in Counter(words_of(text)).items():
                        seen[lang, w] += n
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.string()), pa.array([w for _, w in seen], pa.string()), pa.array(seen.values(), pa.int64())], names=["lang", "word", "n"])

    counted = rows.mapInArrow(releasing(count), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = written(counted, "langid-words")
    if not names or counts.isEmpty():
        return Model(path, [], np.zeros((Pieces(path).size, 0)))
    pieces = Pieces(path)
    place = {x: k for k, x in enumerate(names)}
    flat = 1.0 / (np.arange(pieces.size) + 10.0)
    probs = np.repeat((flat / flat.sum())[:, None], len(names), axis=1)
    for _ in range(rounds):
        shared = labelled.sparkSession.sparkContext.broadcast(probs)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, now = Pieces(path), shared.value
            weighted = now * own.weight[:, None]
            total = np.zeros_like(now)
            for batch in batches:
                for at in range(0, batch.num_rows, TOGETHER):
                    part = batch.slice(at, TOGETHER)
                    n = np.zeros((part.num_rows, len(names)))
                    n[np.arange(part.num_rows), [place[x] for x in part.column(0).to_pylist()]] = part.column(2).to_numpy()
                    total += expected_uses(own, part.column(1).to_pylist(), n, weighted)
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(total[piece, lang])], names=["piece", "lang", "uses"])

        summed = counts.mapInArrow(releasing(expect), "piece int, lang int, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).toArrow()
        uses = np.zeros_like(probs)
        uses[summed["piece"].to_numpy(), summed["lang"].to_numpy()] = summed["uses"].to_numpy()
        share = uses / np.maximum(uses.sum(axis=0), 1e-300)
        mean = 0.9 * share.mean(axis=1) + 0.1 * flat / flat.sum()
        probs = (uses + PRIOR * mean[:, None]) / (uses.sum(axis=0) + PRIOR)
    return Model(path, names, probs)


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with a language and a score for every row."""
    names = [c for c in docs.columns if c not in (lang_out, score_out)]
    frame = docs.select(*names)
    at = names.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            for a, b in _groups(batch.column(at), GROUP_CHARS):
                part = batch.slice(a, b - a)
                langs, scores, _ = scorer.predict(_clean(part.column(at)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores)], names=[*names, lang_out, score_out])

    return frame.mapInArrow(releasing(run), f"{_types(frame)}, `{lang_out}` string, `{score_out}` double")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept out of training: crc32 of its id as text, modulo 4, is 2; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op5_langid(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """The language of every whole text of ``documents``, learned from those that aren't held out."""
    path = path or public_path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()).select("lang", "text"), path)
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")

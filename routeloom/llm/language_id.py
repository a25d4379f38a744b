"""Language identification by unigrams whose segmentations are summed.

Each language has a probability for every piece of a fixed public vocabulary. A word's
probability in a language is the sum, over all ways to cut it into pieces, of the products
of their probabilities; a forward pass over the word's characters computes it. A text's
score is the sum of its words' logarithms, and the prediction the language with the
largest; words are the runs of letters, in lower case, with a mark where they begin.

The probabilities are learned by expectation and maximisation over all words of a bounded
sample of labelled rows: forward and backward passes give each piece's expected count, so
segmentations are summed in training too. Training and prediction cut texts into words by
the same function. All lower-case pieces of letters in the vocabulary are used, whatever
their length; an automaton finds them in many words at once.

Each different word of a Python worker is scored once and kept in a bounded cache.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, in_worker, keyed_texts

BEGIN = "▁"
UNDETERMINED = "und"
#: Probability of a character that is no piece.
RARE = 1e-7
CACHE_ENTRIES = 250_000
TEXT_CHARS = 1 << 20
#: Letters are those of Unicode's category L; number signs such as ½, ² and Ⅳ are none.
LETTERS = regex.compile(r"\p{L}+")


def words_of(text: str) -> list[str]:
    """The runs of letters of a text in lower case."""
    return LETTERS.findall(text.lower())


class Vocabulary:
    _kept: dict[str, Vocabulary] = {}

    def __init__(self, model_path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
        usable = dict.fromkeys(p for p in pieces if p and (p == BEGIN or LETTERS.fullmatch(p.removeprefix(BEGIN))) and p == p.lower())
        self.ids = {p: i + 1 for i, p in enumerate(usable)}  # 0: no such piece
        self.rare = len(self.ids) + 1
        self.size = len(self.ids) + 2
        self.lengths = np.array([0, *map(len, self.ids), 1], np.int64)
        self.longest = int(self.lengths.max())
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()

    @classmethod
    def of(cls, path: str) -> Vocabulary:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def lattice(self, words: list[str], width: int) -> np.ndarray:
        """[word, start, length - 1] -> id of the piece there; words get the mark of a beginning."""
        out = np.zeros((len(words), width, self.longest), np.int32)
        text = "\n".join([BEGIN + w for w in words])  # a line's end is in no piece
        found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        begin = np.cumsum(size + 1) - size - 1
        row = np.repeat(np.arange(len(words)), size + 1)[found[:, 0]]
        length = self.lengths[found[:, 1]]
        out[row, found[:, 0] - length + 1 - begin[row], length - 1] = found[:, 1]
        single = out[:, :, 0]
        single[(single == 0) & (np.arange(width) < size[:, None])] = self.rare
        return out


def _groups(sizes: np.ndarray):
    """(indices, width) of words of like lengths; long words in small groups."""
    order, bounds = np.argsort(sizes, kind="stable"), [4, 6, 8, 10, 12, 16, 20, 26, 34, 48, 64]
    at = 0
    while at < len(order):
        n = int(sizes[order[at]])
        width = next((b for b in bounds if b >= n), None) or 2 ** int(np.ceil(np.log2(n)))
        end = min(int(np.searchsorted(sizes[order], width, side="right")), at + max(1, (1 << 17) // width))
        yield order[at:end], width
        at = end


def _forward(lattice: np.ndarray, p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Logarithm of each word's summed probability in each language, [word, language]. Values are scaled as they shrink."""
    n, width, longest = lattice.shape
    alpha = np.zeros((width + 1, n, p.shape[1]))
    alpha[0] = 1
    scale, out = np.zeros((n, p.shape[1])), np.zeros((n, p.shape[1]))
    for i in range(1, width + 1):
        for length in range(1, min(i, longest) + 1):
            ids = lattice[:, i - length, length - 1]
            if ids.any():
                alpha[i] += alpha[i - length] * p[ids]
        if i % 16 == 0:
            recent = alpha[max(0, i - longest + 1) : i + 1]
            top = recent.max(axis=0)
            top[top == 0] = 1  # past a word's end
            recent /= top
            scale += np.where((sizes >= i)[:, None], np.log(top), 0)
        ends = sizes == i
        if ends.any():
            out[ends] = np.log(alpha[i, ends]) + scale[ends]
    return out


@dataclass(frozen=True)
class Model:
    """languages, and p[piece, language]; p[0] is 0 and p[-1] the probability of a rare character."""

    vocabulary_path: str
    languages: tuple[str, ...]
    p: np.ndarray
    prior: np.ndarray

    def words(self, words: list[str]) -> np.ndarray:
        """Logarithms of the words' probabilities, [word, language]."""
        vocabulary, out = Vocabulary.of(self.vocabulary_path), np.zeros((len(words), len(self.languages)))
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        for rows, width in _groups(sizes):
            out[rows] = _forward(vocabulary.lattice([words[i] for i in rows], width), self.p, sizes[rows])
        return out


def _expected(lattice: np.ndarray, p: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces in one language, over words with counts. Values are scaled as they shrink; the logarithms of the scales are kept."""
    n, width, longest = lattice.shape
    alpha, beta, every = np.zeros((width + 1, n)), np.zeros((width + 1, n)), np.arange(n)
    scale, now = np.zeros((width + 1, n)), np.zeros(n)
    alpha[0] = 1
    beta[sizes, every] = 1
    for i in range(1, width + 1):
        for length in range(1, min(i, longest) + 1):
            ids = lattice[:, i - length, length - 1]
            if ids.any():
                alpha[i] += alpha[i - length] * p[ids]
        scale[i] = now
        if i % longest == 0:
            recent = slice(i - longest + 1, i + 1)  # exactly those since the last time
            top = alpha[recent].max(axis=0)
            top[top == 0] = 1  # past a word's end
            alpha[recent] /= top
            now = now + np.log(top)
            scale[recent] = now
    total = alpha[sizes, every]
    rest = np.where(total > 0, scale[sizes, every] + np.log(np.where(total > 0, total, 1)), np.inf)
    out, now = np.zeros(len(p)), np.zeros(n)
    for i in range(width - 1, -1, -1):
        weight = counts * np.exp(scale[i] + now - rest) * alpha[i]
        for length in range(1, min(width - i, longest) + 1):
            ids = lattice[:, i, length - 1]
            if ids.any():
                through = p[ids] * beta[i + length]
                beta[i] += through
                out += np.bincount(ids, through * weight, len(p))
        if i % longest == 0:
            recent = slice(i, i + longest)
            top = beta[recent].max(axis=0)
            top[top == 0] = 1
            beta[recent] /= top
            now = now + np.log(top)
    return out


def _counted(batches):
    """The words of each language and how often each occurs in a batch."""
    for batch in batches:
        found: dict[str, Counter] = {}
        for language, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found.setdefault(language, Counter()).update(words_of(text.as_py()))
        rows = [(language, word, n) for language, counts in found.items() for word, n in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else ([], [], []), (pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])


def train(labelled: DataFrame, vocabulary_path: str, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_rows: int = 4000, rounds: int = 6) -> Model:
    """Learn from at most sample_rows rows (those with the smallest hashes of their ids) with a language and a text, from all words of these."""
    rows = labelled.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("lang")).where("t is not null and lang is not null")
    # The sample is chosen by ids and hashes alone: no task gathers texts. It has at most sample_rows rows of two numbers.
    rows = rows.where("i is not null").withColumn("th", F.xxhash64("t"))
    chosen = rows.select("i", "th").orderBy(F.xxhash64("i"), "i", "th").limit(sample_rows)
    sample = rows.join(F.broadcast(chosen), ["i", "th"], "left_semi").dropDuplicates(["i", "th"])
    counted = sample.select("lang", "t").mapInArrow(in_worker(_counted), "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    found = counted.toArrow().sort_by([("lang", "ascending"), ("word", "ascending")])  # the words of the sample
    vocabulary = Vocabulary.of(vocabulary_path)
    of = np.array(found.column("lang").to_pylist(), object)
    languages = tuple(dict.fromkeys(of))
    p, totals = np.zeros((vocabulary.size, len(languages))), np.zeros(len(languages))
    for k, language in enumerate(languages):
        own = found.filter(pa.array(of == language))
        words, counts = own.column("word").to_pylist(), own.column("n").to_numpy().astype(float)
        totals[k] = counts.sum()
        sizes = np.array([len(w) + 1 for w in words])
        groups = [(rows, width) for rows, width in _groups(sizes)]
        now = np.full(vocabulary.size, 1 / vocabulary.size)
        for _ in range(rounds):
            now[0], now[-1] = 0, RARE
            # the lattices are made anew in each round: one of them is in memory at a time
            expected = sum(_expected(vocabulary.lattice([words[i] for i in rows], width), now, sizes[rows], counts[rows]) for rows, width in groups) + 0.05
            expected[0] = expected[-1] = 0
            now = expected / expected.sum()
        now[0], now[-1] = 0, RARE
        p[:, k] = now
    return Model(vocabulary_path, languages, p, np.log((totals + 1) / (totals + 1).sum()) if len(languages) else totals)


class Scorer:
    _kept: dict[int, Scorer] = {}

    def __init__(self, model: Model):
        self.model = model
        self.at: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)))
        self.letters = np.zeros(0, np.int64)

    @classmethod
    def of(cls, model: Model) -> Scorer:
        key = hash((model.languages, model.p.tobytes()))
        if key not in cls._kept:
            cls._kept.clear()
            cls._kept[key] = cls(model)
        return cls._kept[key]

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the words' scores, and the number of words, of each text."""
        split = [t.split() for t in texts]
        different = set().union(*split)
        if len(self.at) > CACHE_ENTRIES:
            self.at, self.scores, self.letters = {}, self.scores[:0], self.letters[:0]
        new = [s for s in different if s not in self.at]
        if new:
            runs = [words_of(s) for s in new]
            words = list({w for r in runs for w in r})
            of = dict(zip(words, range(len(words))))
            scores, flat = self.model.words(words), np.array([of[w] for r in runs for w in r], np.int64)
            size = np.array([len(r) for r in runs], np.int64)
            sums = np.zeros((len(new), scores.shape[1]))
            np.add.at(sums, np.repeat(np.arange(len(new)), size), scores[flat])
            self.at.update(zip(new, range(len(self.scores), len(self.scores) + len(new))))
            self.scores, self.letters = np.vstack([self.scores, sums]), np.append(self.letters, size)
        at = self.at.__getitem__
        out, n = np.zeros((len(texts), self.scores.shape[1])), np.zeros(len(texts), np.int64)
        for i, s in enumerate(split):
            rows = np.fromiter(map(at, s), np.int64, len(s))
            out[i], n[i] = self.scores[rows].sum(axis=0), self.letters[rows].sum()
        return out, n


def _parts(text: str):
    start = 0
    while len(text) - start > TEXT_CHARS:
        end = text.find(" ", start + TEXT_CHARS)
        if end < 0:
            break
        yield text[start:end]
        start = end
    yield text[start:]


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, lang_pred, score (the posterior probability of the prediction, 0 to 1).

    Letters are Unicode's (category L). A text without a letter, empty or null, is `und` with score 0; so is every text if the model has no language. Ties go to
    the language first in the alphabet. Repeated rows and null ids are returned like any other. An empty table gives an
    empty result. Other columns are ignored.
    """
    return keyed_texts(docs, id_col, text_col).mapInArrow(in_worker(_predict(model, 0, 1, ["doc_id", "lang_pred", "score"]), Scorer), "doc_id bigint, lang_pred string, score double")


def recognised(docs: DataFrame, model: Model, text_col: str = "text", least_score: float = 0.5) -> DataFrame:
    """The rows of docs, with all columns, whose language is recognised: not `und`, and with a score of at least least_score.

    The rows pass through the prediction, so no join or shuffle is needed.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = rows.mapInArrow(in_worker(_predict(model, 0, 1, ["row", "lang_pred", "score"]), Scorer), f"row {docs.schema.simpleString()}, lang_pred string, score double")
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least_score)).select("row.*")


def _predict(model: Model, kept: int, text: int, names: list[str]):
    """A task's rows: the kept column, the prediction and its score."""

    def run(batches):
        scorer = Scorer.of(model)

        def work(texts):
            if len(texts) > 1:
                return scorer.texts(texts)
            sums, n = zip(*(scorer.texts([part]) for part in _parts(texts[0])))
            return sum(sums), sum(n)

        def all_of(batch):
            part, size = [], 0
            for value in batch.column(text):
                t = value.as_py()
                if part and size + len(t) > TEXT_CHARS:
                    yield work(part)
                    part, size = [], 0
                part.append(t)
                size += len(t)
            if part:
                yield work(part)

        for batch in batches:
            if not batch.num_rows:
                continue
            found = list(all_of(batch))
            sums, n = np.vstack([s for s, _ in found]), np.concatenate([k for _, k in found])
            if not model.languages:
                n[:] = 0
                best, score = np.zeros(len(n), np.int64), np.zeros(len(n))
            else:
                sums = sums + model.prior
                best = sums.argmax(axis=1)
                score = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
            languages = np.array([*model.languages, UNDETERMINED], object)[np.where(n > 0, best, len(model.languages))]
            yield pa.RecordBatch.from_arrays([batch.column(kept), pa.array(languages, pa.string()), pa.array(np.where(n > 0, score, 0.0))], names)

    return run

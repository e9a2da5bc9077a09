"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of one fixed public
vocabulary.  A run of letters, with the vocabulary's word mark in front, is
scored by the forward algorithm, which sums the probabilities of all its
segmentations into pieces; a text's log likelihood is the sum over its runs.
The probabilities come from expectation maximisation (forward-backward) on a
bounded sample of labelled documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curalith.llm.text import crc32_mod, slices
from curalith.llm.workers import remembered

LETTERS = re.compile(r"[^\W\d_]+")
MARK = "▁"
#: Longer runs of letters are scored in parts of this many letters, which keeps products above the smallest double.
PART = 32
#: Probability of a single character that the vocabulary lacks, the same in all languages.
FLOOR = 1e-8
#: Bytes of letter runs and their scores that a worker remembers at most before it forgets them all.
MEMO_BYTES = 64 << 20
#: What a remembered run weighs beside its scores.
RUN_BYTES = 200
#: Bytes of partial sums that the forward algorithm holds at a time.
FORWARD_BYTES = 16 << 20
#: Bytes of text whose runs are held at a time; as Python strings they weigh twenty times as much.
SLICE_BYTES = 1 << 20


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[dict[str, int], int]:
    """Piece -> row (from 1; row 0 is the unknown character) and the longest piece's length."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    kept = [p for p in ordinary if p == p.lower() and MARK not in p[1:] and all(c.isalpha() for c in p.removeprefix(MARK))]
    return {p: k + 1 for k, p in enumerate(dict.fromkeys(kept))}, max(map(len, kept))


def runs_of(text: str) -> list[str]:
    """Marked runs of letters, in lower case."""
    return [MARK + r[k : k + PART] if k == 0 else r[k : k + PART] for r in LETTERS.findall(text.lower()) for k in range(0, len(r), PART)]


def _lattice(run: str, index: dict[str, int], longest: int) -> list[list[tuple[int, int]]]:
    """For each end, the (start, row) of pieces that end there; a lone unknown character has row 0."""
    get = index.get
    return [[(i, r) for i in range(max(0, j - longest), j) if (r := get(run[i:j], 0 if j - i == 1 else None)) is not None] for j in range(1, len(run) + 1)]


def fit_language(counts: Counter[str], index: dict[str, int], longest: int, *, rounds: int = 2, smoothing: float = 0.05) -> np.ndarray:
    """Piece probabilities of one language after ``rounds`` of forward-backward over counted runs."""
    lattices = [(_lattice(run, index, longest), n) for run, n in sorted(counts.items())]
    p = np.full(len(index) + 1, 1.0 / (len(index) + 1)).tolist()
    for _ in range(rounds):
        expected = [0.0] * len(p)
        for ends, n in lattices:
            alpha = [1.0]
            for pieces in ends:
                alpha.append(sum([alpha[i] * p[r] for i, r in pieces]))
            beta = [0.0] * len(ends) + [1.0]
            total = alpha[-1]
            if total <= 0.0:
                continue
            for j in range(len(ends), 0, -1):
                after = beta[j]
                for i, r in ends[j - 1]:
                    beta[i] += p[r] * after
                    expected[r] += n * alpha[i] * p[r] * after / total
        expected[0] = 0.0
        whole = sum(expected) + smoothing * len(index)
        p = [(e + smoothing) / whole for e in expected]
    p[0] = FLOOR
    return np.array(p)


@dataclass(frozen=True)
class Model:
    """``probabilities[row, language]``, at most (vocabulary + 1) x languages numbers."""

    path: str
    languages: list[str]
    probabilities: np.ndarray

    def key(self) -> tuple:
        return "language", self.path, tuple(self.languages), xxhash.xxh3_128_hexdigest(np.ascontiguousarray(self.probabilities))


def training_rows(docs: DataFrame, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit("null")).cast("binary")) % folds != 0


def fit(docs: DataFrame, path: str, *, per_language: int = 200) -> Model:
    """Fit on about ``per_language`` training documents of each language, drawn by a hash of id and text.

    The draw is what bounds the driver's memory; training rows are those whose
    crc32(doc_id) isn't 0 modulo 5 with a language and a text.
    """
    train = docs.select("doc_id", "text", "lang").where(training_rows(docs) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    totals = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    if not totals:
        return Model(path, [], np.zeros((1, 0)))
    scale = 1 << 30
    drawn = None
    for lang, n in sorted(totals.items()):
        mine = (F.col("lang") == lang) & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(scale)) < math.ceil(scale * min(1.0, per_language / n)))
        drawn = mine if drawn is None else drawn | mine
    counts: dict[str, Counter[str]] = defaultdict(Counter)
    for row in train.where(drawn).select("lang", "text").toLocalIterator():
        counts[row["lang"]].update(runs_of(row["text"]))
    index, longest = vocabulary(path)
    languages = sorted(totals)
    return Model(path, languages, np.stack([fit_language(counts[x], index, longest) for x in languages], axis=1))


class Scorer:
    """Log likelihoods of letter runs under every language, remembered by run."""

    def __init__(self, model: Model):
        self.index, self.longest = vocabulary(model.path)
        self.p = model.probabilities
        self.k = len(model.languages)
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, self.k))  # grows by doubling; rows in use come first

    def learn(self, runs: list[str]) -> None:
        """The forward algorithm for all runs of one length at a time, in blocks of bounded size."""
        new = [r for r in set(runs) if r not in self.rows]
        if (len(self.rows) + len(new)) * (RUN_BYTES + 8 * self.k) > MEMO_BYTES:
            self.rows, self.table, new = {}, np.zeros((0, self.k)), list(set(runs))
        at = len(self.rows)
        if at + len(new) > len(self.table):
            grown = np.zeros((max(at + len(new), 2 * len(self.table)), self.k))
            grown[:at] = self.table[:at]
            self.table = grown
        by_length: dict[int, list[str]] = defaultdict(list)
        for r in new:
            by_length[len(r)].append(r)
        for n, group in by_length.items():
            block = max(1, FORWARD_BYTES // (8 * (n + 2) * max(1, self.k)))
            for a in range(0, len(group), block):
                part = group[a : a + block]
                self.table[at : at + len(part)] = self._forward(part, n)
                self.rows.update(zip(part, range(at, at + len(part)), strict=True))
                at += len(part)

    def _forward(self, group: list[str], n: int) -> np.ndarray:
        """Log of the summed probability of all segmentations of runs of ``n`` characters, by language."""
        get = self.index.get
        alpha = [np.ones((len(group), self.k))]
        for j in range(1, n + 1):
            total = np.zeros((len(group), self.k))
            for i in range(max(0, j - self.longest), j):
                if j - i == 1:
                    ids = np.array([get(r[i], 0) for r in group])
                    total += alpha[i] * self.p[ids]
                else:
                    ids = np.array([get(r[i:j], -1) for r in group])
                    hit = np.flatnonzero(ids >= 0)
                    if len(hit):
                        total[hit] += alpha[i][hit] * self.p[ids[hit]]
            alpha.append(total)
        return np.log(alpha[-1])

    def score(self, runs: list[str]) -> np.ndarray:
        return self.table[[self.rows[r] for r in runs]].sum(axis=0)


#: Bytes of probabilities that may be sent to every executor: the vocabulary times about 250 languages.
BROADCAST_BYTES = 64 << 20


def _send(spark: SparkSession, model: Model) -> tuple[Broadcast, tuple]:
    if model.probabilities.nbytes > BROADCAST_BYTES:
        raise ValueError(f"{len(model.languages)} languages are more than a broadcast model may hold")
    return spark.sparkContext.broadcast(model), model.key()


def predict(docs: DataFrame, model: Model, *, folds: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score (the language's posterior under a flat prior).

    ``und`` with score 0 for a null text, a text without a letter, or a model
    without languages.  Reads doc_id and text only.  Map-only; what is sent to
    the executors is bounded by the vocabulary times the number of languages.
    """
    shared, key = _send(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = remembered(key, lambda: Scorer(model))
        for b in slices(batches, SLICE_BYTES):
            ids = b.column(0).to_pylist()
            texts = [runs_of(t or "") for t in b.column(1).to_pylist()]
            if model.languages:
                scorer.learn([r for t in texts for r in t])
            best, score = [], []
            for t in texts:
                if not t or not model.languages:
                    best.append("und")
                    score.append(0.0)
                    continue
                k, certain = _posterior(scorer.score(t))
                best.append(model.languages[k])
                score.append(certain)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([crc32_mod(i, folds) == 0 for i in ids], pa.bool_()), pa.array(best, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def keep_certain(docs: DataFrame, model: Model, certain: float) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language with a score of at least ``certain``.

    Null texts, texts without a letter, and with a model without languages all
    rows, go.  Rows pass as they are, with a null id as with any other; nothing
    is joined, so repeated ids are no matter.
    """
    shared, key = _send(docs.sparkSession, model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = remembered(key, lambda: Scorer(shared.value))
        for b in slices(batches, SLICE_BYTES):
            runs = [runs_of(t or "") for t in b.column(at).to_pylist()]
            if shared.value.languages:
                scorer.learn([r for t in runs for r in t])
            keep = [bool(t) and _posterior(scorer.score(t))[1] >= certain if shared.value.languages else False for t in runs]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _posterior(log: np.ndarray) -> tuple[int, float]:
    k = int(np.argmax(log))
    return k, float(1.0 / np.exp(log - log[k]).sum())

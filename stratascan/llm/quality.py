"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

A document's features are the hashes of its distinct words and their beginnings, of shapes of words with the share they have, and of a few
traits of the whole text. One weight per hash is shared by all grades; ordered thresholds turn the score into the
probabilities P(grade > g) = sigmoid(score - threshold_g). Documents stay if the probability of the top grade
is at least one half; the expected grade orders them.

The model is fitted on at most ``SAMPLE`` labelled documents, chosen by a hash of their ids; every document is scored,
over its whole text. Grades: 0 toxic, 1 not toxic but of low quality, 2 neither. Null and empty texts have traits only.
Null ids are scored. Without any labels every score is 0 and all documents stay. Repeated rows are scored alike. Of several labels of a document the highest grade
counts; a label without quality and toxicity counts as low quality. A probability of exactly one half stays. Very long texts are scored whole. An empty table gives an
empty result. Only doc_id and text are read of documents, so other columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratascan.llm.common import table, tune

BITS = 20
#: Labelled documents that the model is fitted on, at most.
SAMPLE = 8000
#: A feature counts if this many of them have it.
LEAST_DOCS = 4
GRADES = 3
PENALTY = 8.0
#: Shapes and traits are few beside words; several hashes each make the penalty weigh less on them.
TRAIT_HASHES = 4
STEPS = 150
SEED = 3

_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _hash(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key) >> (64 - BITS)


def shape(word: bytes) -> bytes:
    """Case of the letters and what punctuation ends the word: ``Aa.``, ``AA!!``."""
    core = word.rstrip(_PUNCTUATION)
    tail = word[len(core) :][:3]
    if not core:
        return b"-" + tail
    kind = b"09" if core.isdigit() else b"AA" if core.isupper() and len(core) > 1 else b"Aa" if core[:1].isupper() else b"aa"
    return kind + tail


class _Known(dict):
    """Word -> (feature, features of its first four and five letters, number of its shape), up to a bound."""

    LIMIT = 300_000

    def __init__(self) -> None:
        self.shapes: dict[bytes, int] = {}

    def __missing__(self, word: bytes) -> tuple[int, int, int, int]:
        if len(self) >= self.LIMIT:
            self.clear()
        core = word.strip(_PUNCTUATION).decode("utf-8", "replace").lower()
        number = self.shapes.setdefault(shape(word), len(self.shapes))
        value = self[word] = (*(_hash(f"{kind}:{part}".encode()) for kind, part in (("w", core), ("4", core[:4]), ("5", core[:5]))), number)
        return value


def _level(share: float) -> int:
    return 0 if share <= 0 else max(1, 9 + math.floor(math.log2(share)))


class Features:
    """Ascending distinct feature numbers of a text."""

    def __init__(self) -> None:
        self.known = _Known()

    def of(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").split()
        n = len(words)
        if len(self.known.shapes) > 5000:
            self.known = _Known()
        rows = np.array([self.known[w] for w in words], np.int64).reshape(n, 4)
        found, times = np.unique(rows[:, 0], return_counts=True)
        extra = [b"all"]
        if n:
            names = list(self.known.shapes)
            for i, c in zip(*np.unique(rows[:, 3], return_counts=True), strict=True):
                extra.append(b"s:%s:%d" % (names[i], _level(c / n)))
            extra += [b"distinct:%d" % int(10 * len(found) / n), b"top:%d" % int(10 * times.max() / n), b"length:%d" % int(math.log2(n)), b"mean:%d" % min(20, len(text) // n)]
        return np.unique(np.concatenate([found, np.unique(rows[:, 1:3]), np.array([_hash(b"%d:" % i + x) for x in extra for i in range(TRAIT_HASHES)], np.int64)]))


@dataclass
class Model:
    """Weights by feature and ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tail(self, score: np.ndarray) -> np.ndarray:
        """P(grade > g), a column for each g below the top."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -50, 50)))


def fit(rows: list[np.ndarray], grades: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> Model:
    """Maximum penalised likelihood by full-batch Adam over sparse rows."""
    size = 1 << BITS
    if not rows:
        return Model(np.zeros(size, np.float32), np.full(GRADES - 1, -np.inf))
    flat = np.concatenate(rows)
    counts = np.bincount(flat, minlength=size)
    used = np.flatnonzero(counts >= LEAST_DOCS)
    place = np.full(size, -1, np.int64)
    place[used] = np.arange(len(used))
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = place[flat]
    doc, col = doc[col >= 0], col[col >= 0]

    n, k = len(rows), GRADES
    share = np.array([(grades > g).mean() for g in range(k - 1)]).clip(0.5 / n, 1 - 0.5 / n)
    # thresholds as the first and the logs of the gaps, which keeps them in order
    theta = -np.log(share / (1 - share))
    at = np.concatenate([np.zeros(len(used)), theta[:1], np.log(np.maximum(np.diff(theta), 1e-2))])
    first, second = np.zeros(len(at)), np.zeros(len(at))
    for step in range(1, steps + 1):
        grad = loss(at, doc, col, grades, penalty)[1]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        at = at - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(size, np.float32)
    weights[used] = at[: len(used)]
    return Model(weights, ordered(at[len(used) :]))


def ordered(raw: np.ndarray) -> np.ndarray:
    """Thresholds from the first one and the logs of the gaps."""
    return raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))])


def loss(at: np.ndarray, doc: np.ndarray, col: np.ndarray, grades: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Penalised negative log-likelihood and its gradient at weights followed by raw thresholds; cells (doc, col) are the features that documents have."""
    n, k = len(grades), GRADES
    w, raw = at[: len(at) - k + 1], at[len(at) - k + 1 :]
    score = np.bincount(doc, w[col], n)
    edge = np.concatenate([np.full((n, 1), np.inf), score[:, None] - ordered(raw)[None, :], np.full((n, 1), -np.inf)], axis=1)
    p = 1 / (1 + np.exp(-np.clip(edge, -500, 500)))
    d = p * (1 - p)
    of = np.arange(n)
    likely = np.maximum(p[of, grades] - p[of, grades + 1], 1e-12)
    up, down = d[of, grades] / likely, d[of, grades + 1] / likely  # of the lower and the upper edge of the grade
    g_w = -np.bincount(col, (up - down)[doc], len(w)) + penalty * w
    g_theta = np.array([np.sum(up[grades == g + 1]) - np.sum(down[grades == g]) for g in range(k - 1)])
    g_raw = np.concatenate([[g_theta.sum()], [g_theta[i:].sum() * np.exp(raw[i]) for i in range(1, k - 1)]])
    return float(-np.log(likely).sum() + penalty / 2 * (w @ w)), np.concatenate([g_w, g_raw])


def grade(quality: Column, toxic: Column) -> Column:
    return F.when(toxic > 0, 0).when(quality > 0, 2).otherwise(1)


def _text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> Model:
    """Fit on a sample of the labelled documents, drawn by a hash of the id; bounded, so it may be collected."""
    tune(docs.sparkSession)
    graded = labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade(F.col("quality"), F.col("toxic")).alias("grade")).where("doc_id IS NOT NULL AND grade IS NOT NULL")
    total = graded.count()
    share = min(1.0, sample / max(1, total))
    chosen = graded.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000) + 1).groupBy("doc_id").agg(F.max("grade").alias("grade")).orderBy(F.xxhash64("doc_id", F.lit(seed))).limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in batches:
            rows = [features.of(t).astype(np.int32) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("grade"), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "grade", "features"])

    # at most ``sample`` rows of two numbers are broadcast
    rows = _text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", "text").mapInArrow(run, "doc_id long, grade int, features binary")
    got = sorted({(r["doc_id"], r["grade"], bytes(r["features"])) for r in rows.limit(2 * sample).collect()})
    return fit([np.frombuffer(f, np.int32) for _, _, f in got], np.array([g for _, g, _ in got], np.int64))


def score(docs: DataFrame, model: Model, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score, expected_grade, p_top) for every row, and its columns ``extra`` in a struct ``doc``."""
    spark = tune(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, m = Features(), sent.value
        for b in batches:
            s = np.array([float(m.weights[features.of(t)].sum(dtype=np.float64)) for t in b.column("text").to_pylist()])
            tail = m.tail(s)
            columns = [b.column("doc_id"), pa.array(s), pa.array(tail.sum(axis=1)), pa.array(tail[:, -1] if len(s) else s)]
            yield pa.RecordBatch.from_arrays([*columns, *([b.column("doc")] if extra else [])], ["doc_id", "score", "expected_grade", "p_top", *(["doc"] if extra else [])])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), *([F.struct(*[docs[c] for c in extra]).alias("doc")] if extra else []))
    schema = "doc_id long, score double, expected_grade double, p_top double"
    if extra:
        schema += f", doc {rows.schema['doc'].dataType.simpleString()}"
    return rows.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose probability of the top grade is at least ``least``, with its columns."""
    model = train(docs, labels)
    good = score(docs, model, tuple(docs.columns)).where(F.col("p_top") >= least)
    return good.select("doc.*")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and chance of the top grade of every document."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "score", "expected_grade", "p_top", (F.col("p_top") >= 0.5).alias("kept"))

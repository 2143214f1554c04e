"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Each line with a word is one position of the chain, good (1) or bad (0). Its features are shares of symbols, capitals,
digits, repeated words and the like, of the line and of the lines before and after it. Training gives every line the
label of its document, so the chain learns how lines of one kind follow each other; forward-backward passes give
each line's probability of being good, and the document's score is their mean weighted by line length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bound_batches, row_slices, text_bytes

# The model is fitted on at most so many labelled documents (smallest hash of the id first), each with at most so many lines.
SAMPLE_DOCUMENTS = 4000
SAMPLE_LINES = 500
THRESHOLD = 0.3
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
DIGITS = bytes(range(48, 58))
SYMBOLS = b"#*$%&|<>{}[]\\^~=+_@/"
STOPS = b".,;:?"
SHOUTS = b"!"
FEATURES = 11


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(features, length in bytes) of the lines that have a word; whole text."""
    rows, sizes, seen = [], [], set()
    for line in text.split(b"\n"):
        words = line.split()
        if not words:
            continue
        n, k = len(line), len(words)
        count = lambda kind: n - len(line.translate(None, kind))  # noqa: E731, B023
        letters = count(LETTERS)
        rows.append(
            (
                count(SYMBOLS) / n,
                count(UPPER) / max(1, letters),
                count(DIGITS) / n,
                count(STOPS) / n,
                count(SHOUTS) / n,
                letters / n,
                sum(map(eq, words, words[1:])) / k,
                1 - len(set(words)) / k,
                np.log1p(k),
                n / k,
                float(line in seen),
            )
        )
        seen.add(line)
        sizes.append(n)
    return np.array(rows, np.float64).reshape(-1, FEATURES), np.array(sizes, np.float64)


def _inputs(features: list[np.ndarray], mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Feature rows of all documents end to end: own, line before, line after (zeros beyond the ends), constant."""
    out = []
    for rows in features:
        x = np.clip((rows - mean) / scale, -6, 6)
        edge = np.zeros((1, x.shape[1]))
        out.append(np.hstack((x, np.vstack((edge, x[:-1])), np.vstack((x[1:], edge)), np.ones((len(x), 1)))))
    return np.vstack(out)


class Chains:
    """Sequences end to end, walked step by step: longest first, so step t covers a prefix of them."""

    def __init__(self, lengths: np.ndarray):
        order = np.argsort(-lengths, kind="stable")
        starts = (np.cumsum(lengths) - lengths)[order]
        self.lengths = lengths[order]
        self.starts = starts
        longest = int(self.lengths[0]) if len(lengths) else 0
        active = np.searchsorted(-self.lengths, -np.arange(longest), side="left")
        self.steps = [starts[:a] + t for t, a in enumerate(active)]

    def marginals(self, emission: np.ndarray, transition: np.ndarray):
        """(P(good) per line, expected transition counts (2, 2), sum of log partition functions).

        Line scores are 0 for bad and ``emission`` for good.
        """
        n = len(emission)
        unary = np.stack((np.zeros(n), emission), axis=1)
        alpha, beta, scale = np.empty((n, 2)), np.zeros((n, 2)), np.zeros(n)
        table = np.exp(transition)
        top = unary.max(axis=1, keepdims=True)
        local = np.exp(unary - top)
        for t, at in enumerate(self.steps):
            a = local[at] if t == 0 else (alpha[at - 1] @ table) * local[at]
            z = a.sum(axis=1)
            alpha[at], scale[at] = a / z[:, None], z
        pair = np.zeros((2, 2))
        beta[self.starts + self.lengths - 1] = 1
        for t in range(len(self.steps) - 1, 0, -1):
            at = self.steps[t]
            ahead = local[at] * beta[at] / scale[at][:, None]
            beta[at - 1] = ahead @ table.T
            pair += table * (alpha[at - 1].T @ ahead)
        good = alpha * beta
        return good[:, 1] / good.sum(axis=1), pair, float((np.log(scale) + top[:, 0]).sum())


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    transition: np.ndarray
    base: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """P(good) of each text, 0 to 1; a text without words gets the share of good training documents."""
        out = np.full(len(texts), self.base)
        found = [line_features(t) for t in texts]
        own = [i for i, (f, _) in enumerate(found) if len(f)]
        if not own or not len(self.weights):
            return out
        lengths = np.array([len(found[i][0]) for i in own])
        emission = _inputs([found[i][0] for i in own], self.mean, self.scale) @ self.weights
        good, _, _ = Chains(lengths).marginals(emission, self.transition)
        sizes = np.concatenate([found[i][1] for i in own])
        starts = np.cumsum(lengths) - lengths
        out[own] = np.clip(np.add.reduceat(good * sizes, starts) / np.add.reduceat(sizes, starts), 0, 1)
        return out


def train(features: list[np.ndarray], labels: np.ndarray, rounds: int = 300, penalty: float = 1e-3, rate: float = 0.05) -> Model:
    """Penalised maximum likelihood by full-batch gradient steps with adaptive step sizes; deterministic."""
    if not len(features):
        return Model(np.zeros(FEATURES), np.ones(FEATURES), np.empty(0), np.zeros((2, 2)), 0.5)
    every = np.vstack(features)
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-6
    x = _inputs(features, mean, scale)
    lengths = np.array([len(f) for f in features])
    chains = Chains(lengths)
    y = np.repeat(labels.astype(np.float64), lengths)
    same = np.zeros((2, 2))
    for label in (0, 1):
        same[label, label] = (lengths[labels == label] - 1).sum()
    theta = np.zeros(x.shape[1] + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        good, pair, _ = chains.marginals(x @ theta[:-4], theta[-4:].reshape(2, 2))
        gradient = np.concatenate((x.T @ (good - y), (pair - same).ravel())) / len(y) + penalty * theta
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        theta -= rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    return Model(mean, scale, theta[:-4], theta[-4:].reshape(2, 2), float(labels.mean()))


def held_out(doc_id):
    """Whether a row is kept from training: crc32 of the id as text, modulo 5, is 0 (null ids never train)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCUMENTS, lines: int = SAMPLE_LINES) -> Model:
    """Fit on at most ``sample`` labelled documents of at most ``lines`` lines with words, none of them held out.

    An id with several labels has the smallest, one without a label is not used. Features are made by Spark tasks;
    only those of the bounded sample reach the driver. No labelled document: every score is 0.5.
    """
    bound_batches(docs.sparkSession)
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in row_slices(batches, "t"):
            ids, goods, found = [], [], []
            for doc, quality, text in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "quality", "t"))):
                made, _ = line_features(text)
                if 0 < len(made) <= lines:
                    ids.append(doc)
                    goods.append(quality)
                    found.append(made.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(goods, pa.int32()), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    # The sample is bounded by ``sample`` ids, so it may go to every task.
    texts = docs.select("doc_id", text_bytes().alias("t")).join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), "t")
    # One text per id, whatever the order of rows: that with the smallest hash.
    texts = texts.groupBy("doc_id", "quality").agg(F.min_by("t", F.xxhash64("t")).alias("t"))
    rows = texts.mapInArrow(run, "doc_id long, quality int, x array<double>").toPandas()
    rows = rows.assign(h=[tuple(x[:FEATURES]) for x in rows["x"]], n=rows["x"].map(len)).sort_values(["doc_id", "n", "h"])
    return train([np.asarray(x).reshape(-1, FEATURES) for x in rows["x"]], rows["quality"].to_numpy())


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``: ``predicted`` is 1 from ``threshold`` on.

    Only the text is looked at. Null and empty texts, and texts of white space, get the share of good documents
    in training. Repeated rows get equal scores; other columns are not read; no rows: no rows.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in row_slices(batches, "t"):
            found = shared.value.scores(rows.column("t").to_pylist())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(found)], ["doc_id", "score"])

    scored = docs.select("doc_id", text_bytes().alias("t")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, all columns kept, decided where the text is read."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(texts: pa.Array) -> pa.Array:
        rows = pa.RecordBatch.from_arrays([texts.fill_null(b"")], ["t"])
        found = [shared.value.scores(part.column("t").to_pylist()) for part in row_slices(iter([rows]), "t")]
        return pa.array(np.concatenate(found) if found else np.empty(0), pa.float64())

    return docs.where(F.arrow_udf(scores, "double")(F.col("text").cast("binary")) >= threshold)

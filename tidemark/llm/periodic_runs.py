"""Periodic runs: stretches of words that repeat with a period, found by seeds and diagonals.

A run of period q and length L >= max(12, 2q) agrees with itself, q words on, over L - q words: at least 6 of them, and at
least q. So seeds of ``k`` = 6 words meet every run of a period under 12, and seeds of k = 12, 24, 48 ... words every run of a
period in [k, 2k). Two places of one document with the same seed lie on a diagonal, whose lag is their distance. Only pairs
that open a diagonal, unlike words before them, are taken from the seed lists: the others are passed over a whole
stretch of like words at a time, so even a text of one word a million times over gives a pair per lag, not one per two places. Pairs are
extended to the right, left to right over all lags; a table per lag holds how far its diagonal is covered, by an extension or
as a multiple of a found period, and what it covers is not extended again. What is extended therefore has its smallest period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import bound_batches, list_column, row_slices, text_bytes

MIN_LENGTH = 12
MIN_PERIODS = 2
RUN = "struct<start: bigint, length: bigint, period: bigint>"


def _ranked(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1]


def _pairs(places: np.ndarray, ranks: np.ndarray, words: np.ndarray, starts: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of the pairs with one seed and a lag in [least, most) that have unlike words, or a document's edge, before them.

    ``places`` are in the order of (rank, place), ``starts`` marks the first word of each document.
    """
    n = len(places)
    before = np.where(starts[places], -1, words[np.maximum(places - 1, 0)])
    last = np.concatenate((ranks[1:] != ranks[:-1], [True]))
    # The next entry of the list with another word before it: the end of the stretch of like ones.
    turn = np.concatenate(((before[1:] != before[:-1]) | last[:-1], [True]))
    ends = np.nonzero(turn)[0]
    other = ends[np.searchsorted(ends, np.arange(n))] + 1
    span = int(places.max()) + most + 1
    key = ranks * span + places
    x = np.arange(n)
    y = np.searchsorted(key, key + least)
    found_places, found_lags = [], []
    while len(x):
        inside = y < n
        x, y = x[inside], y[inside]
        like = (before[y] == before[x]) & (before[x] >= 0) & (ranks[y] == ranks[x])
        y = np.where(like, other[y], y)
        inside = y < n
        x, y = x[inside], y[inside]
        near = (ranks[y] == ranks[x]) & (places[y] - places[x] < most)
        x, y = x[near], y[near]
        found_places.append(places[x])
        found_lags.append(places[y] - places[x])
        y = y + 1
    if not found_places:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found_places), np.concatenate(found_lags)


def diagonals(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of every diagonal's opening in documents laid end to end, by place and then lag."""
    n = len(words)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)  # words from here to the document's end
    starts = np.zeros(n, bool)
    starts[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    ranks = np.full(n, -1, np.int64)

    def keep_repeated(at: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Places whose seed occurs again in their document; ``ranks`` numbers their seeds, all others get -1."""
        found = _ranked(key)
        again = np.bincount(found)[found] > 1
        ranks[:] = -1
        ranks[at[again]] = found[again]
        return at[again]

    def longer(at: np.ndarray, step: int, length: int) -> np.ndarray:
        """Seeds of ``length`` words: a repeated seed here and one ``step`` words on."""
        at = at[room[at] >= length]
        at = at[ranks[at + step] >= 0]
        return keep_repeated(at, ranks[at] * (n + 1) + ranks[at + step]) if len(at) else at

    at = keep_repeated(np.arange(n), doc * (int(words.max()) + 1) + words) if n else np.empty(0, np.int64)
    k = 1
    for step, length in ((1, 2), (1, 3), (3, MIN_LENGTH // 2)):
        at = longer(at, step, length)
        k = length
    places, lags = [], []
    least = 1
    while len(at):
        order = np.argsort(ranks[at], kind="stable")
        found = _pairs(at[order], ranks[at][order], words, starts, least, 2 * k)
        places.append(found[0])
        lags.append(found[1])
        at = longer(at, k, 2 * k)
        k, least = 2 * k, 2 * k
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    places, lags = np.concatenate(places), np.concatenate(lags)
    order = np.lexsort((lags, places))
    return places[order], lags[order]


def _agreement(words: np.ndarray, place: int, lag: int, end: int) -> int:
    """How many words from ``place`` on equal the word ``lag`` further, up to the document's ``end``."""
    reach, width = 0, 32
    while place + lag + reach < end:
        stop = min(place + reach + width, end - lag)
        unlike = words[place + reach : stop] != words[place + reach + lag : stop + lag]
        first = int(unlike.argmax()) if unlike.any() else -1
        if first >= 0:
            return reach + first
        reach, width = stop - place, 2 * width
    return reach


def runs_of(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows (document, start, length, period) of all runs, by document, start and period; starts count from the document's first word."""
    places, lags = diagonals(words, sizes)
    firsts = np.cumsum(sizes) - sizes
    owners = np.searchsorted(np.cumsum(sizes), places, side="right")
    found, covered, doc = [], {}, -1
    for place, lag, owner in zip(places.tolist(), lags.tolist(), owners.tolist()):
        if owner != doc:
            covered, doc = {}, owner
        if place < covered.get(lag, 0):
            continue
        end = int(firsts[doc] + sizes[doc])
        reach = _agreement(words, place, lag, end)
        covered[lag] = place + reach
        if reach >= (MIN_PERIODS - 1) * lag and reach + lag >= MIN_LENGTH:
            found.append((doc, place - int(firsts[doc]), reach + lag, lag))
            for multiple in range(2 * lag, reach + lag, lag):
                covered[multiple] = max(covered.get(multiple, 0), place + reach + lag - multiple)
    return np.array(found, np.int64).reshape(-1, 4)


def kept_words(runs: np.ndarray, size: int) -> np.ndarray:
    """Which words stay: those that no run (start, length, period) contains after its first period."""
    marks = np.zeros(size + 1, np.int64)
    np.add.at(marks, runs[:, 0] + runs[:, 2], 1)
    np.add.at(marks, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(marks[:-1]) == 0


def find_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row of ``docs``: all runs by start and period, and the words left, joined by one space.

    Words are what ASCII white space separates. Null, empty and blank texts have no words, no runs and an empty collapsed
    text. Repeated rows and ids are judged row by row; other columns are not read; no rows: no rows. Work and memory of a text
    are in proportion to its length but for a logarithm.
    """
    bound_batches(docs.sparkSession)
    fields = ["start", "length", "period"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in row_slices(batches, "t"):
            split = [t.split() for t in rows.column("t").to_pylist()]
            sizes = np.array([len(w) for w in split], np.int64)
            numbers: dict[bytes, int] = {}
            words = np.fromiter((numbers.setdefault(w, len(numbers)) for doc in split for w in doc), np.int64, int(sizes.sum()))
            found = runs_of(words, sizes)
            bounds = np.searchsorted(found[:, 0], np.arange(len(sizes) + 1))
            texts = []
            for i, doc in enumerate(split):
                own = found[bounds[i] : bounds[i + 1], 1:]
                texts.append(b" ".join(doc if not len(own) else [w for w, stay in zip(doc, kept_words(own, len(doc)).tolist()) if stay]))
            values = pa.StructArray.from_arrays([pa.array(found[:, c]) for c in (1, 2, 3)], fields)
            runs = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)
            collapsed = pa.array(texts, pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(sizes), runs, collapsed], ["doc_id", "n_words", "runs", "collapsed"])

    picked = docs.select("doc_id", text_bytes().alias("t"))
    found = picked.mapInArrow(run, f"doc_id {picked.dtypes[0][1]}, n_words bigint, runs array<{RUN}>, collapsed binary")
    return found.withColumn("collapsed", found.collapsed.cast("string"))
